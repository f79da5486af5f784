"""Robots by path, redirects, peers, medians, classes, JSON-LD and stored answers against plain Python."""

import http.server
import itertools
import json
import random
import re
import statistics
import threading
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagelens.functions import jsonld as J
from pagelens.functions import text as T
from pagelens.operators import crawl, jsonld_walk, peers, redirects, robots_index
from pagelens.operators.order_statistics import exact_medians, first_rows
from pagelens.operators.ordering import settled
from pagelens.operators.relational import alike_pages, similar_classes
from pagelens.plans import page_audit, rubric, site_items
from pagelens.sources import answers

# Robots


def _verdict(body, agent, path):
    groups, now, rules_seen = [], None, False
    for line in body.splitlines():
        line = line.split("#")[0].strip()
        if ":" not in line:
            continue
        key, value = (x.strip() for x in line.split(":", 1))
        if key.lower() == "user-agent":
            if now is None or rules_seen:
                now, rules_seen = ([], []), False
                groups.append(now)
            now[0].append(value.lower())
        elif key.lower() in ("allow", "disallow") and now is not None:
            now[1].append((key.lower(), value))
            rules_seen = True
    kind, rules = "none", []
    for name, word in ((agent.lower(), "explicit"), ("*", "wildcard")):
        found = next((g for g in groups if name in g[0]), None)
        if found:
            kind, rules = word, found[1]
            break
    hits = [(len(v), k == "allow", v) for k, v in rules if v and re.match("^" + re.escape(v).replace(r"\*", ".*").replace(r"\$", "$"), path)]
    return kind, max(hits)[1] if hits else True


def test_robots_of_paths(spark):
    rng = random.Random(8)
    bodies = {"tabs": "User-agent:\tGooglebot\nDisallow:\t/\n\tUser-agent: *\n\t\tDisallow: /private\t# x\n", "none": "", "root": "User-agent: *\nDisallow: /\nAllow: /$\n", "odd": "User-agent: *\nDisallow: /a+b(c)?[d]\nAllow: /*.{js}$\nDisallow: /*/x$\nDisallow: \\q\n"}
    for k in range(12):
        rules = [f"{rng.choice(['Allow', 'Disallow'])}: {rng.choice(['/', '/a', '/a/', '/a/b', '/*b', '/a*c$', '/b$', '', '*', '/a/*/c', '$'])}" for _ in range(rng.randint(0, 6))]
        bodies[f"s{k}"] = "\n".join(["User-agent: " + rng.choice(["*", "Googlebot", "GPTBot"]), *rules[:3], "User-agent: " + rng.choice(["*", "Bingbot"]), *rules[3:]])
    paths = ["/", "/a", "/a/", "/a/b", "/a/b/c", "/b", "/private", "/private/x", "/a+b(c)?[d]", "/z.{js}", "/q/x", "/x"]
    robots = spark.createDataFrame(list(bodies.items()), "site string, body string")
    asked = spark.createDataFrame([(s, k, p) for s in bodies for k, p in enumerate(paths)] + [("unseen", 0, "/")], "site string, page int, path string")
    agents = spark.createDataFrame([("Googlebot",), ("Bingbot",), ("GPTBot",)], "agent string")
    got = robots_index.page_verdicts(robots, crawl.robots_rules(robots), asked, agents).collect()
    assert {(r.site, paths[r.page], r.agent): (r.grp_kind, r.allowed) for r in got} == {(s, p, a): _verdict(b, a, p) for s, b in bodies.items() for p in paths for a in ("Googlebot", "Bingbot", "GPTBot")}
    assert len(got) == len(bodies) * len(paths) * 3
    assert any(not r.allowed for r in got if r.site == "tabs") and robots_index.page_verdicts(robots.where("false"), crawl.robots_rules(robots.where("false")), asked, agents).collect() == []


# Redirects


def _followed(url, table):
    hops = 0
    while hops <= 4:
        if url not in table:
            return url, None, hops
        status, location = table[url]
        if status is not None and 300 <= status < 400 and location:
            url, hops = urljoin(url, location), hops + 1
            continue
        return url, status, hops
    return url, None, hops


def test_redirects(spark):
    table = {
        "https://a.com/": (301, "/home"), "https://a.com/home": (302, "sub/page?x=1"), "https://a.com/sub/page?x=1": (200, "https://never/"), "https://loop/": (301, "https://loop/"), "https://b/1": (308, "//b/2"), "https://b/2": (301, "https://b/1"),
        "https://gone/": (404, None), "https://down/": (None, None), "https://empty/": (301, ""), "https://four/0": (301, "1"), "https://four/1": (301, "2"), "https://four/2": (301, "3"), "https://four/3": (301, "4"), "https://four/4": (200, None), "https://five/": (302, "https://four/0"),
    }
    rows = [(u, s, x) for u, (s, x) in table.items()]
    repeated = [("https://a.com/", 599, None), ("https://gone/", 404, None), ("https://four/0", 301, "zzz")]
    starts = [(u,) for u in [*table, *table, "https://unknown/"]]
    got = redirects.follow_redirects(spark.createDataFrame(starts, "start string"), spark.createDataFrame(rows + repeated, "url string, status int, location string")).collect()
    assert {r.start: (r.url, r.status, r.hops) for r in got} == {u: _followed(u, table) for (u,) in starts} and len(got) == len(table) + 1
    scores = {r.start: r.T5 for r in site_items.canonical_landing(spark.createDataFrame([tuple(r) for r in got], "start string, url string, status int, hops int")).collect()}
    assert scores["https://loop/"] is None and scores["https://a.com/"] == 3 and scores["https://gone/"] == 0 and scores["https://five/"] is None
    none = spark.createDataFrame([], "start string"), spark.createDataFrame([], "url string, status int, location string")
    assert redirects.follow_redirects(*none).collect() == []


# Peers


def test_peers(spark):
    rng = random.Random(2)
    heads, entries = [], []
    for site in range(6):
        for k in range(rng.choice([1, 2, 7, 20, 45])):
            terms = None if rng.random() < 0.15 else sorted({f"t{rng.randint(0, 6)}" for _ in range(rng.randint(0, 4))})
            heads.append((site * 1000 + k, f"s{site}", f"https://s{site}/{k}", " ".join(terms or []) or None, terms))
            if rng.random() < 0.7:
                entries.append((f"s{site}", k, f"https://s{site}/{k}"))
    entries.append(("s0", 99, "https://s0/never-seen"))
    seen = {h[2]: h for h in heads}
    want = {}
    for page, site, url, title, _ in heads:
        locs = [u for s, _, u in sorted(entries) if s == site]
        locs = locs if url in locs else [url, *locs]
        step = max(1, len(locs) // 6)
        near = [seen[u] for u in locs[::step][:6] if u in seen and seen[u][4] is not None]
        clash = sum(1 for a, b in itertools.combinations(near, 2) if a[4] and b[4] and len(set(a[4]) & set(b[4])) >= 0.6 * len(set(a[4]) | set(b[4])))
        twins = sum(1 for p in near if title and p[3] == title and p[2] != url)
        want[page] = (len(near), clash, twins, None if len(near) < 3 else 3 if clash == 0 else 2 if clash == 1 else 1 if clash <= 3 else 0)
    table = spark.createDataFrame(heads, "page int, site string, url string, title string, terms array<string>")
    listed = spark.createDataFrame(entries, "site string, pos int, url string")
    got = peers.peer_items(peers.page_peers(table, listed)).collect()
    assert {r.page: (r.n_peers, len(r.clashes), len(r.twins), r.K1) for r in got} == want and len(got) == len(heads)


# Medians, first rows and classes


def test_medians(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, 0.0, 0.0, 0.5, rng.random()]), rng.randint(0, 9)) for _ in range(500)] + [("one", 2.5, None), ("none", None, None)]
    got = {r.g: (r.x, r.y) for r in exact_medians(spark.createDataFrame(rows, "g string, x double, y int"), ["g"], ["x", "y"]).collect()}
    median = lambda v: statistics.median(v) if v else None
    want = {g: (median([r[1] for r in rows if r[0] == g and r[1] is not None]), median([r[2] for r in rows if r[0] == g and r[2] is not None])) for g in ("a", "b", "c", None, "one")}
    assert {g: got[g] for g in want} == want and "none" not in got
    assert exact_medians(spark.createDataFrame([], "g string, x double"), ["g"], ["x"]).collect() == []


def test_first_rows_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("o"))
    two = first_rows(rows, ["g"], ["o"], 2)
    assert sorted(tuple(r) for r in two.collect()) == sorted((g, -o, k) for g in range(3) for k, o in enumerate([x for x in range(999, 990, -1) if x % 3 == g][:2]))
    assert two._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_one_title_on_very_many_pages_is_one_class(spark):
    many = spark.range(100_000).select(F.lit("s").alias("site"), F.col("id").alias("page_id"), F.explode(F.array(F.lit("free"), F.lit("pdf"), F.lit("tool"))).alias("term"))
    few = spark.createDataFrame([("s", -1, t) for t in ("free", "pdf")] + [("s", 200_000, "other"), ("t", 5, "free")], "site string, page_id long, term string")
    classes, members, links = similar_classes(many.unionByName(few))
    assert sorted(tuple(r) for r in classes.collect()) == [("s", -1, 1), ("s", 0, 100_000), ("s", 200_000, 1), ("t", 5, 1)]
    assert members.count() == 100_003 and [tuple(r)[:5] for r in links.collect()] == [("s", -1, 0, 1, 100_000)]
    assert [tuple(r) for r in alike_pages(classes, links).collect()] == [("s", 100_000 * 99_999 // 2 + 100_000)]


def test_a_title_with_most_pages_is_split(spark):
    """Page scores and titles meet in a join that Spark splits where one title has most of the pages."""
    html = "<html lang='en'><title>404</title><h1>x</h1><p>" + "word " * 30 + "</p>"
    pages = spark.range(12_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://big.com/"), "id").alias("url"), F.when(F.col("id") % 50 > 0, html).otherwise(F.concat(F.lit("<title>t"), F.col("id"), F.lit("</title>"))).alias("html"))
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        items = page_audit.audit_items(settled(page_audit.facts(pages).repartition(8))).select("page_id", "I1")
        rows = items.collect()
        assert "skew=true" in items._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 12_000 and all(r.I1 == (0 if r.page_id % 50 else 2) for r in rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# JSON-LD

RAW = [
    '{"@type":"Article","a":12.50,"b":[1,{"@type":["X","Y",3]}],"c":true,"d":null}', '{"a":1} x', '{"a":1,"a":2}', '{"a":NaN}', '{"a":1e5}', '{"a":1,}', '[1,2,"s"]', '"text"', "5", "", '{"a":-0}',
    '{"a":-0.0,"b":0.10,"c":100,"d":1.0,"e":123456789012345678}', '{"a":"\\ud800"}', '{"k":"line\nbreak"}', '{"deep":' + "[" * 40 + '{"@type":"Deep","v":1}' + "]" * 40 + "}", '{"@type":"A"} {"@type":"B"}', ' {"@type" : "Sp" , "n": 0.000001 } ',
    '{"@type":"Bad",', '{"a":"q\\"uote","u":"\\u00e9"}', '{"": "empty"}', '{"a":00}', '{"a":.5}', '{"x":[[],{}, {"y":[{"@type":"In"}]}]}',
]


def test_json_ld_by_both_parsers(spark):
    block = "<script type='application/ld+json'>{}</script>"
    rows = [(k, "<p>x</p>" + block.replace("{}", r)) for k, r in enumerate(RAW)] + [(100, "<p>none</p>"), (101, None), (102, "".join(block.replace("{}", r) for r in RAW[:6])), (103, "")]
    df = spark.createDataFrame(rows, "page_id int, html string")
    plain = lambda r: (r.ld.blocks, r.ld.broken, r.ld.types, sorted(map(tuple, r.ld.pairs)))
    want = {r.page_id: plain(r) for r in df.where("html is not null").select("page_id", J.page_facts(F.col("html")).alias("ld")).collect()}
    assert {r.page_id: plain(r) for r in jsonld_walk.page_facts(df).collect()} == want
    assert want[0][2] == ["Article", "X", "Y"] and json.loads(RAW[0])["a"] == 12.5
    assert {r.page_id: plain(r) for r in jsonld_walk.page_facts(df, levels=2).collect()} == want


# Answers


def test_stored_answers(spark, tmp_path):
    answers.register(spark)
    path = f"file://{tmp_path}/answers"
    rows = [(f"h{k % 7}.com", f"https://h{k % 7}.com/{k}", None, 200 if k % 3 else None, {"content-type": "text/html"}, None if k % 3 == 0 else bytes([k % 256, 0, 255]), None if k % 3 else "timed out") for k in range(300)]
    df = spark.createDataFrame(rows, answers.COLUMNS)
    df.repartition("host").write.format("stored_answers").mode("append").save(path)
    read = lambda: spark.read.format("stored_answers").load(path)
    key = lambda r: (r[1], r[3], bytes(r[5]) if r[5] is not None else None, r[6], sorted(r[4].items()))
    assert sorted(map(key, read().collect()), key=repr) == sorted(map(key, rows), key=repr)
    one = read().where("host = 'h3.com' and status = 200")
    assert sorted(r.url for r in one.collect()) == sorted(r[1] for r in rows if r[0] == "h3.com" and r[3] == 200)
    assert one.rdd.getNumPartitions() == 1 < read().rdd.getNumPartitions()
    assert read().where("host = 'nowhere.com'").collect() == []
    df.limit(5).write.format("stored_answers").mode("append").save(path)
    assert read().count() == 305
    df.limit(5).write.format("stored_answers").mode("overwrite").save(path)
    assert read().count() == 5
    empty = f"file://{tmp_path}/none"
    df.where("false").write.format("stored_answers").mode("append").save(empty)
    assert spark.read.format("stored_answers").load(empty).count() == 0


class _Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(301)
            self.send_header("Location", "/page")
            self.end_headers()
            return
        self.send_response(404 if self.path == "/gone" else 200)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(b"<title>" + self.path.encode() + b"</title>")

    do_HEAD = do_GET

    def log_message(self, *a):
        pass


def test_live_answers(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        urls = [f"{base}/page", f"{base}/gone", f"{base}/moved", "http://127.0.0.1:1/refused", None]
        spark.createDataFrame([(u,) for u in urls], "url string").write.parquet(f"{tmp_path}/urls")
        answers.register(spark)
        load = lambda **more: {r.url: r for r in spark.read.format("live_answers").options(urls=f"file://{tmp_path}/urls", timeout="5", **more).load().collect()}
        got = load()
        assert {u: r.status for u, r in got.items()} == {urls[0]: 200, urls[1]: 404, urls[2]: 200, urls[3]: None}
        assert bytes(got[urls[0]].body) == b"<title>/page</title>" and got[urls[2]].final_url.endswith("/page") and got[urls[3]].error and got[urls[1]].error == "http_404"
        heads = load(method="HEAD")
        assert heads[urls[2]].status == 301 and heads[urls[2]].headers["location"] == "/page"
    finally:
        server.shutdown()


# Small things


def test_white_space_of_all_kinds_goes(spark):
    df = spark.createDataFrame([("\t\u00a0 a b\x1c\n",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.stripped(F.col("t"))).collect()] == ["a b", None, ""]


@pytest.mark.parametrize(("lane", "codes"), [("audit", [0, 1, 1]), ("write", [0, 1, 2]), ("meta", [0, 1, 2])])
def test_exit_codes(spark, lane, codes):
    df = spark.createDataFrame([("PASS",), ("REWORK",), ("REJECT",)], "v string")
    assert [r[0] for r in df.select(rubric.exit_code(F.col("v"), lane)).collect()] == codes


def test_tables_belong_to_their_owner(spark):
    import os

    from pagelens.operators.ordering import drop_settled, settling

    folder = lambda t: t.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option, None)
    outside = settled(spark.range(3))
    with settling(spark):
        inside = settled(spark.range(4))
        with settling(spark):
            inner = folder(settled(spark.range(5)))
        assert not os.path.exists(inner) and inside.count() == 4
        drop_settled(spark)
        assert not os.path.exists(folder(outside)) and inside.count() == 4
        place = folder(inside)
    assert not os.path.exists(place) and spark.conf.get(option, None) == before
    threads = [threading.Thread(target=lambda: settled(spark.range(100)).count()) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(option, None) == before
    drop_settled(spark)


def test_topics_of_questions(spark):
    from pagelens.operators.teardown import topic_pages

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    topics, questions = [(word(rng.randint(1, 9)), k) for k in range(120)], ["", "A", "ab", *(word(rng.randint(1, 5)) for _ in range(60)), None]
    got = topic_pages(spark.createDataFrame(topics, "topic string, page_id int"), spark.createDataFrame([(q,) for q in questions], "question string")).collect()
    assert sorted(tuple(r) for r in got) == sorted({(q, t, k) for q in questions if q is not None for t, k in topics if q.lower() in t})


# Settings that keep or mend a quirk


def test_first_words_in_han(spark):
    html = "<html lang='zh'><title>生成器</title><h1>x</h1><p>生成器 转换 工具</p>"
    page = page_audit.facts(spark.createDataFrame([(1, "https://x.com/", html)], "page_id int, url string, html string"))
    assert [page_audit.audit_items(page, compat=c).first().C2 for c in (True, False)] == [0, 3]


def test_decimals_in_sources(spark):
    from pagelens.plans import draft_lane

    block = "<p>It has 12.5 GB and 40 GB, says <a href='https://s.org/1'>s</a>.</p>"
    drafts = spark.createDataFrame([(1, block, block, None, None)], "id int, draft string, block string, question string, self_host string")
    sources = spark.createDataFrame([("https://s.org/1", 200, "40 only")], "url string, status int, text string")
    none = spark.createDataFrame([], "id int, density double")
    assert [draft_lane.draft_items(drafts, sources, none, compat=c).first().W5 for c in (True, False)] == [3, 2]


def test_extra_peers(spark):
    pages = spark.createDataFrame([(k, "s", f"https://s/{k}", f"t{k}", [f"t{k}", "all"]) for k in range(4)], "page int, site string, url string, title string, terms array<string>")
    entries = spark.createDataFrame([("s", k, f"https://s/{k}") for k in range(3)], "site string, pos int, url string")
    extra = spark.createDataFrame([(0, "https://s/1"), (0, "https://s/3"), (0, "https://s/3"), (0, "https://s/none"), (3, "https://s/3")], "page int, url string")
    for compat, want in ((True, {0: (6, 2, 1), 1: (3, 0, 3), 2: (3, 0, 3), 3: (5, 1, 2)}), (False, {0: (4, 0, 3), 1: (3, 0, 3), 2: (3, 0, 3), 3: (4, 0, 3)})):
        got = peers.peer_items(peers.page_peers(pages, entries, extra=extra, compat=compat)).collect()
        assert {r.page: (r.n_peers, len(r.clashes), r.K1) for r in got} == want
