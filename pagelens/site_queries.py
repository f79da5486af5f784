"""Queries on robots rules, sitemaps, JSON-LD, drafts, other sites' topics and fixes; most on inline rows, as the tables hold none of these."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from .functions import jsonld as J
from .functions import text as T
from .functions import urls as U
from .operators import crawl as C
from .operators import redirects
from .operators import probes as P
from .operators import relational as R
from .operators import teardown as D
from .plans import draft_lane, fixes, meta_lane, page_audit, rubric, site_items
from .sinks import reports
from .sources.responses import decoded
from .sources.tables import pages, table

# --- robots ----------------------------------------------------------------------------------------------------------

#: site, status and body of robots.txt.
ROBOTS = [
    ("all", 200, "User-agent: *\nAllow: /\n"),
    ("blank", 200, " \n"),
    ("gone", 404, None),
    ("html", 200, "<!DOCTYPE html><HTML><body>User-agent: *\nDisallow: /</body>"),
    ("down", 503, None),
    ("cut", None, None),
    ("refused", 403, "User-agent: *\nDisallow: /"),
    ("training", 200, "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nSitemap: https://training/map.xml\n"),
    ("search", 200, "allow\nuser-agent: googlebot\ndisallow: / # closed\nnoindex: /old\nSITEMAP: /a.xml\nSitemap: b.xml\nUser-agent: OAI-SearchBot\nDisallow: /*\nAllow: /$\n"),
    ("two", 200, "User-agent: bingbot\nDisallow:\nUser-agent: bingbot\nDisallow: /\nUser-agent: *\nDisallow: /\nAllow: /\n"),
]


def _robots(spark):
    return spark.createDataFrame(ROBOTS, "site string, status int, body string")


def robots_observation(spark, sf_dir):
    return C.observed_robots(_robots(spark)).select("site", "observed", "reason")


def robots_groups(spark, sf_dir):
    return C.robots_rules(C.observed_robots(_robots(spark)).where("observed")).select("site", "grp", "agent", "kind", "value")


def robots_rule_lines(spark, sf_dir):
    """Decisions that a rule made, with that rule."""
    seen = C.observed_robots(_robots(spark)).where("observed")
    return C.robots_decisions(seen, C.agent_table(spark).select("agent")).where("rule is not null").where(F.col("agent").isin("Googlebot", "Bingbot", "OAI-SearchBot", "GPTBot"))


def blocked_classes(spark, sf_dir):
    return C.robots_classes(_robots(spark)).where("blocked <> ''").select("site", "class", "blocked")


def robots_sitemap_lines(spark, sf_dir):
    return C.robots_sitemaps(C.observed_robots(_robots(spark)))


def robots_noindex_lines(spark, sf_dir):
    return C.robots_noindex(C.observed_robots(_robots(spark)))


_PROBES = [("a", None, 200), ("a", "OAI-SearchBot", 403), ("a", "PerplexityBot", 200), ("a", "ChatGPT-User", 429), ("b", None, 403), ("b", "OAI-SearchBot", 403), ("c", None, 200), ("c", "OAI-SearchBot", 404), ("d", None, None), ("d", "OAI-SearchBot", 401)]


def blocked_by_server(spark, sf_dir):
    return C.blocked_by_server(spark.createDataFrame(_PROBES, "site string, agent string, status int"))


def index_gate_of_robots(spark, sf_dir):
    """G2 from what robots.txt answered; one site sends noindex as a header."""
    return site_items.index_gate(C.robots_classes(_robots(spark)), spark.createDataFrame([("blank", "header")], "site string, place string"))


# --- sitemaps --------------------------------------------------------------------------------------------------------

_SITES = [("a", "https://a.com"), ("b", "https://b.com"), ("c", "https://c.com"), ("d", "https://d.com")]
_DECLARED = [("a", 0, "/maps/one.xml"), ("a", 1, "https://a.com/sitemap.xml"), ("d", 0, "//cdn.d.com/map.xml")]
_SET = "<?xml version='1.0'?><urlset>{}</urlset>"
#: url, status and body of what was fetched.
CRAWL = [
    ("https://a.com/maps/one.xml", 404, None),
    ("https://a.com/sitemap.xml", 200, _SET.format("<url><loc> https://a.com/ </loc><lastmod>2026-08-20</lastmod></url><url><lastmod>2026-08-20</lastmod></url><url><loc>/b</loc></url>")),
    ("https://a.com/sitemap", 200, _SET.format("<url><loc>https://a.com/never</loc></url>")),
    ("https://b.com/sitemap.xml", 200, "<html><body>no page &lt;urlset</body></html>"),
    ("https://b.com/sitemap_index.xml", 200, "<sitemapindex>" + "".join(f"<sitemap><loc>https://b.com/{k}.xml</loc></sitemap>" for k in range(4)) + "</sitemapindex>"),
    ("https://b.com/0.xml", 200, _SET.format("<url><loc>https://b.com/0</loc></url>")),
    ("https://b.com/1.xml", 500, None),
    ("https://b.com/2.xml", 200, "<urlset><loc>https://b.com/2</loc><loc>https://b.com/3</loc></urlset>"),
    ("https://c.com/sitemap.xml", 404, None),
    ("https://c.com/sitemap_index.xml", 500, None),
    ("https://c.com/sitemap-index.xml", 404, None),
    ("https://c.com/sitemap", 404, None),
    ("https://cdn.d.com/map.xml", 200, _SET.format("<url><loc>https://d.com/x</loc></url>")),
]


def _crawl(spark):
    return spark.createDataFrame(CRAWL, "url string, status int, body string")


def _tried(spark):
    found = C.sitemap_candidates(spark.createDataFrame(_SITES, "site string, origin string"), spark.createDataFrame(_DECLARED, "site string, pos int, line string"))
    return C.tried_sitemaps(found, _crawl(spark))


def _files(spark):
    return C.sitemap_files(C.chosen_sitemaps(_tried(spark)), _crawl(spark))


def sitemap_discovery(spark, sf_dir):
    return C.chosen_sitemaps(_tried(spark))


def sitemap_found_in_crawl(spark, sf_dir):
    return site_items.sitemap_found(_tried(spark))


def sitemap_parse(spark, sf_dir):
    return C.sitemap_entries(_files(spark))


def sitemap_limits(spark, sf_dir):
    return C.sitemap_limits(_files(spark))


_DATES = ["2026-08-20", "2026-8-2", "2026-13-45", "2026-02-30", "2026-08-20T10:00:00", "2026-08-20T10:00:00Z", "2026-08-20T10:00:00+08:00", "2026-08-20T10:00:00+0800", "2026-08-20T10:00:00.5Z", "2026-08-20T10:00:00.5", "2026-08-20T10:00Z", "2026-08-20T10:00", "2026-08-20T25:00:00", "20.08.2026", "2026-08", " 2026-08-20 ", ""]


def lastmod_dates(spark, sf_dir):
    return spark.createDataFrame([(d,) for d in _DATES], "lastmod string").select("lastmod", C.is_date(F.col("lastmod")).alias("valid"))


# --- addresses -------------------------------------------------------------------------------------------------------

_LINKS = ["https://o.org/x", "//cdn.net/y?z#w", "/root?q=1", "page.html", "../up/./x", "../../../top", "?only", "#part", "", "mailto:a@b.c", "sub/", ".."]


def joined_links(spark, sf_dir):
    return spark.createDataFrame([(k, x) for k, x in enumerate(_LINKS)], "id int, link string").select("id", U.joined(F.lit("http://Host.com:80/a/b/c.html?old#f"), F.col("link")).alias("url"))


def origins(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.origin_of(F.col("url")).alias("origin"), U.origin_of(U.bare_host(F.col("url"))).alias("bare"))


# --- pages with what the tables lack ---------------------------------------------------------------------------------

_LD = "<script type='application/ld+json'>{}</script>"
_LONG = "<p>" + "plain word " * 70 + "</p>"
#: page_id, url, status and html, one page for each branch of T4, T7, T8, T9, I2, I3 and for what is no observation.
PAGES = [
    (1, "https://x.com/a", 200, "<html lang='en'><title>One good title here</title><link rel='canonical' href='https://x.com/a'>" + _LD.format('{"@type": ["Article", "Thing"], "offers": {"price": 12.5}}') + _LONG + "<p>It costs 12.5</p>"),
    (2, "https://x.com/en/b", 200, "<html lang='en_US'><link rel='canonical' href='/b'><link rel='canonical' href='/c'>" + _LD.format('{"@type":"Article",}') + "<h1>a</h1>"),
    (3, "https://x.com/zh-hans/c", 200, "<html lang='zh'><link rel='canonical' href='/c'><link rel='alternate' hreflang='zh' href='https://X.com/zh-hans/c/'><link rel='alternate' hreflang='X-Default' href='/'>" + _LD.format('{"@type":"Organization"}') + _LD.format("[1,") + "<h1>a</h1><h1>b</h1>"),
    (4, "https://x.com/ar/d", 200, "<html lang='ar'><link rel='canonical' href='http://x.com/d'><link rel='alternate' hreflang='ar' href='https://x.com/ar/d'>" + _LD.format('{"@graph":[{"@type":"FAQPage","price":"99","ratingValue":4.5,"reviewCount":7,"x":{"ratingCount":true}}]}')),
    (5, "https://x.com/fr-ca/e", 200, "<html lang='fr' dir=rtl><link rel='canonical' href='https://x.com/e#f'><link rel='alternate' hreflang='en' href='https://x.com/en/e'>" + _LD.format("{") + _LD.format("[") + _LD.format('{"a": 1}')),
    (6, "https://x.com/de/f", 200, "<html lang='en'><link rel='canonical'>" + _LD.format('"text"') + "<p>9 GB</p>"),
    (7, "https://x.com/he/g", 200, "<html lang='he' dir='rtl'><p>10 USD and 4 min</p>" + _LD.format('{"price":"10","deep":[[{"ratingValue":"4"}]]}')),
    (8, "https://x.com/h", 403, "<html lang='en'><title>Denied</title>"),
    (9, "https://x.com/i", 200, ""),
    (10, "https://x.com/j", None, None),
    (12, "https://x.com/l", 200, "<p>a</p>" + _LD.format('{"price": "5"}')),
    (13, "https://x.com/m", 200, "<p>a</p>" + _LD.format('{"price": "5", "ratingValue": 6}')),
    (11, "https://x.com/k", 200, "<html><p>x</p>" + _LD.format('{"@type":"Nope" broken, "price": "1"}')),
]


def _inline_pages(spark):
    return spark.createDataFrame(PAGES, "page_id int, url string, status int, html string")


def inline_audit_items(spark, sf_dir):
    return page_audit.audit_items(page_audit.facts(_inline_pages(spark)))


def jsonld_types(spark, sf_dir):
    f = _inline_pages(spark).select("page_id", J.page_facts(F.col("html")).alias("f")).where("html is not null")
    return f.select("page_id", F.col("f.blocks").alias("blocks"), F.col("f.broken").alias("broken"), F.array_join("f.types", ",").alias("types"))


def jsonld_values(spark, sf_dir):
    f = _inline_pages(spark).where("html is not null").select("page_id", F.explode(J.page_facts(F.col("html"))["pairs"]).alias("p"))
    return f.select("page_id", F.col("p.key").alias("key"), F.col("p.value").alias("value"))


def jsonld_consistency(spark, sf_dir):
    return site_items.declared_values(_inline_pages(spark).where(F.col("status") == 200))


_MEDIA = [(1, "<img src='a.png' alt='x'><IMG alt=''><img src=\"b.png\">"), (2, "<p>none</p>"), (3, None)]


def page_images(spark, sf_dir):
    i = spark.createDataFrame(_MEDIA, "id int, html string").select("id", F.posexplode(T.images(F.col("html"))).alias("pos", "i"))
    return i.select("id", "pos", "i.src", "i.alt")


_OUT = [(1, "<a href='https://www.B.org/x'>b</a><a href='http://a.net:80'>a</a><a href='https://b.org/y'>b</a><a href='/in'>i</a><a href='https://self.com/z'>s</a>"), (2, "none")]


def external_domains(spark, sf_dir):
    rows = spark.createDataFrame(_OUT, "id int, html string")
    return rows.select("id", F.array_join(U.domains(T.external_links(F.col("html"), F.lit("self.com"))), ",").alias("domains"))


_QUOTES = [(1, "<p>It has 30 MB of data. Is this a question that is long enough? Yes it is, indeed it is.</p><li>Since 2020-05 it works</li><p>no fact</p><p>Will it work for all of us tomorrow？</p>")]


def winner_pages(spark, sf_dir):
    rows = spark.createDataFrame([(k, "https://w.com/", h) for k, h in _QUOTES], "page_id int, url string, html string")
    w = D.winner_pages(page_audit.facts(rows))
    return w.select("page_id", "observed", "n_blocks", "n_fact_blocks", F.array_join("quotable", "|").alias("quotable"), F.array_join("questions", "|").alias("questions"))


_META = [(1, "<html><meta name='robots' content=' NoIndex, follow'>", None), (2, "<html>", "noindex"), (3, "<meta name='robots' content='index'>", "none, NOINDEX")]


def noindex_of_answers(spark, sf_dir):
    rows = spark.createDataFrame(_META, "id int, html string, header string")
    return P.noindex_signals(rows.select("id", T.meta_robots(F.col("html")).alias("meta_robots"), "header"))


_RAW = [
    (1, "Grüße".encode("latin-1"), None, "text/html; charset=ISO-8859-1"),
    (2, gzip.compress("<p>é</p>".encode(), mtime=0), "gzip", "text/html"),
    (3, b"<meta charset='windows-1252'>\x80", None, None),
    (4, b"ok \xff", "gzip", "text/html; charset=no-such"),
    (5, None, None, None),
]


def decoded_answers(spark, sf_dir):
    rows = spark.createDataFrame(_RAW, "id int, raw binary, encoding string, content_type string")
    return rows.select("id", decoded(F.col("raw"), F.col("encoding"), F.col("content_type")).alias("text"))


_ANSWERS = [("http://x.com", "https://x.com/", 200), ("https://x.com", "https://x.com:443", 200), ("http://www.x.com", None, None), ("https://www.x.com", "https://blocked/", 403), ("http://y.org", "http://y.org/", 200), ("https://www.y.org", "https://www.y.org/", 200)]


def _entry_points(spark):
    return P.entry_points(spark.createDataFrame([("x.com",), ("www.y.org",)], "site string"), spark.createDataFrame(_ANSWERS, "url string, final string, status int"))


def entry_points(spark, sf_dir):
    return _entry_points(spark)


#: For the site of PAGES: robots.txt, the crawl of its sitemap, its sample and what its canonical addresses answer.
_SITE = "x.com"
_HOPS = [("https://x.com/a", 200, None), ("https://x.com/c", 404, None), ("http://x.com/d", 301, "https://x.com/d"), ("https://x.com/d", 200, None)]
_MAP = [("https://x.com/sitemap.xml", 200, _SET.format("<url><loc>https://x.com/a</loc></url><url><loc>http://x.com/b</loc></url>"))]
_SAMPLE = [(_SITE, 200, False), (_SITE, 404, False), (_SITE, 403, False)]


def _evidence(spark):
    """Every item of each page of PAGES, from all its evidence; K1 has none."""
    pages_ = _inline_pages(spark)
    seen = page_audit.facts(pages_).select("page_id", U.joined(F.col("url"), F.get("canonical", F.lit(0))).alias("start")).where("start is not null")
    hops = spark.createDataFrame(_HOPS, "url string, status int, location string")
    t5 = seen.join(site_items.canonical_landing(redirects.follow_redirects(seen.select("start").distinct(), hops)), "start").select("page_id", "T5")
    g1 = site_items.reach_gate(pages_.select(F.col("page_id").alias("id"), "status")).withColumnRenamed("id", "page_id")
    robots = spark.createDataFrame([(_SITE, 200, "User-agent: GPTBot\nDisallow: /\n")], "site string, status int, body string")
    g2 = site_items.index_gate(C.robots_classes(robots), spark.createDataFrame([], "site string, place string"))
    crawl = spark.createDataFrame(_MAP, "url string, status int, body string")
    tried = C.tried_sitemaps(C.sitemap_candidates(spark.createDataFrame([(_SITE, "https://x.com")], "site string, origin string"), spark.createDataFrame([], "site string, pos int, line string")), crawl)
    files = C.sitemap_files(C.chosen_sitemaps(tried), crawl)
    t2 = site_items.sitemap_score(C.sitemap_hygiene(C.sitemap_entries(files)), C.sitemap_limits(files))
    t3 = P.sample_liveness(spark.createDataFrame(_SAMPLE, "site string, status int, redirected boolean")).select("site", "T3")
    t6 = P.variant_landings(_entry_points(spark)).select("site", "T6")
    return page_audit.all_items(pages_, [g1, t5], [g2, site_items.sitemap_found(tried), t2, t3, t6], list(rubric.AUDIT_WEIGHTS))


def evidence_scorecard(spark, sf_dir):
    card = rubric.scorecard(rubric.long_scores(_evidence(spark), "page_id", list(rubric.AUDIT_WEIGHTS)), rubric.rubric(spark))
    return card.select(F.col("entity").alias("page_id"), "got", "full", "failed_gates", "below_floor", "unobserved", F.round("ratio", 9).alias("ratio"), "verdict")


# --- other sites -----------------------------------------------------------------------------------------------------

MINE = "ththth.example.net"


def _traits(spark, sf_dir):
    return D.page_traits(page_audit.facts(pages(spark, sf_dir)))


def site_topics(spark, sf_dir):
    return D.topics(_traits(spark, sf_dir), MINE).withColumn("density", F.round("density", 9))


def bench_gaps(spark, sf_dir):
    return D.bench(_traits(spark, sf_dir), "site").withColumn("median_density", F.round("median_density", 9))


def _rival(k, site, title, body):
    return (k, f"https://{site}/{k}", f"<html><title>{title}</title><h1>{title}</h1>{body}")


_FAQ = _LD.format('{"@type":"FAQPage"}') + _LD.format('{"@type":"HowTo"}')
#: page_id, url and html of three sites.
RIVALS = [
    _rival(1, "mine.com", "Alpha beta", "<p>none</p>"),
    _rival(2, "bravo.com", "Gamma delta bravo", "<p>30 MB</p><p>x</p><table border=1><td>y</td></table><img src=a>" + _FAQ),
    _rival(3, "bravo.com", "Gamma delta de", "<p>30 MB <a href='https://o.org'>o</a></p>"),
    _rival(4, "charlie.com", "Gamma epsilon alpha", "<p>z</p>"),
    _rival(5, "charlie.com", "Gamma epsilon tools", "<p>z</p>"),
    _rival(6, "charlie.com", "Epsilon", "<p>z</p>"),
]


def _rivals(spark):
    return D.page_traits(page_audit.facts(spark.createDataFrame(RIVALS, "page_id int, url string, html string")))


def inline_topics(spark, sf_dir):
    return D.topics(_rivals(spark), "mine.com").withColumn("density", F.round("density", 9))


def topic_pages(spark, sf_dir):
    return D.topic_pages(D.topics(_rivals(spark), "mine.com", None), spark.createDataFrame([("AMM",), ("eps",), ("zeta",)], "question string"))


def inline_bench(spark, sf_dir):
    return D.bench(_rivals(spark), "site").withColumn("median_density", F.round("median_density", 9))


# --- fixes and lanes -------------------------------------------------------------------------------------------------

#: entity, item, score and the key of the finding.
SCORES = [("p", "G1", 1, "ok"), ("p", "G2", 0, "robots"), ("p", "T1", 0, None), ("p", "T3", 3, None), ("p", "C1", None, None), ("q", "G1", 0, "dead"), ("q", "T4", 2, None), ("q", "T7", 1, None), ("r", "K2", 1, None), ("r", "T2", 0, None), ("r", "C3", 1, None), ("s", "T4", 3, None)]


def _fixed(spark):
    rows = spark.createDataFrame(SCORES, "entity string, item string, score int, fix_key string")
    return fixes.with_fixes(rows, rubric.rubric(spark), fixes.fix_table(spark))


def fix_lookup(spark, sf_dir):
    return _fixed(spark).select("entity", "item", "passed", F.col("fix").isNotNull().alias("has_fix"), F.substring("fix", 1, 12).alias("begins"))


def next_fix(spark, sf_dir):
    return fixes.next_fix(_fixed(spark)).select("entity", "item")


def fix_first(spark, sf_dir):
    return fixes.fix_first(_fixed(spark), list(rubric.AUDIT_WEIGHTS)).select("entity", "item")


def check_commands(spark, sf_dir):
    rows = spark.createDataFrame([(i,) for i in ("G2", "T4", "T6", "C3", "K1")], "item string")
    return rows.select("item", fixes.check_command(F.col("item"), F.lit("https://www.a.com:8443/x?y")).alias("command"))


_GOOD_TITLE, _GOOD_TEXT = "PDF converter for teams, free", "Convert a PDF to PNG in 3 seconds, no sign-up needed, and export all files as often as you like."
#: id, title, description, keyword and page type, one row for each branch of the meta lane.
META = [
    (1, _GOOD_TITLE, _GOOD_TEXT, "pdf converter", "tool"),
    (2, "Short", "Too short", "pdf", "home"),
    (3, "A title of a pdf", None, "pdf", "tool"),
    (4, "Free PDF export in 3 seconds", None, "none", "pricing"),
    (5, None, _GOOD_TEXT, None, None),
    (6, "converter of files", "converter of files and files", "files", "home"),
    (7, "An editor for developers costs 9 USD in " + "very " * 8, "Make it. " * 8, "developers", "pricing"),
    (8, "生成器和转换器工具", "给团队的在线工具", "转换", "home"),
    (9, "amazing best ever revolutionary", "unleash the cutting-edge and supercharge", "unleash", "blog"),
    (10, "alpha beta gamma delta", "alpha beta gamma omega", "delta", "home"),
]


def meta_branches(spark, sf_dir):
    return meta_lane.meta_items(spark.createDataFrame(META, "id int, title string, description string, keyword string, page_type string"))


def meta_scorecard(spark, sf_dir):
    """The meta lane to its end; M7 needs pages and is unobserved here."""
    items = list(rubric.META_WEIGHTS)
    wide = meta_branches(spark, sf_dir).withColumn("M7", F.lit(None).cast("int"))
    card = rubric.scorecard(rubric.long_scores(wide, "id", items), rubric.rubric(spark, rubric.META_WEIGHTS))
    return card.select(F.col("entity").alias("id"), "got", "full", "failed_gates", "below_floor", "unobserved", "verdict")


_FENCED = [
    (1, "intro\n```html\n<p>kept 12 GB</p>\n```\n```markdown\nnot this\n```"),
    (2, "```md\n# M\n```"),
    (3, "```bash\ncurl x\n```"),
    (4, None),
]


def draft_block_extract(spark, sf_dir):
    return spark.createDataFrame(_FENCED, "id int, draft string").select("id", draft_lane.content_block(F.col("draft")).alias("block"))


_CITED = "<p>It weighs {} and {}, says <a href='https://s.org/1'>s</a>.</p>"
#: Drafts for the branches of W5, W6 and W8: id, draft, question and own host.
DRAFTS = [
    (1, "```html\n" + _CITED.format("5 kg 12 GB", "1,300 MB") + "<img src=a alt='b'><figcaption>c</figcaption>" + _LD.format('{"@type":["ImageObject","HowTo"]}') + "\n```", None, None),
    (2, "```html\n" + _CITED.format("77 GB", "88 GB") + "<img src=a>" + _LD.format('{"@type":"Article",}') + "\n```", None, None),
    (3, "```html\n" + _CITED.format("12 GB", "99 GB") + "<video src=a></video><figcaption>c</figcaption>" + _LD.format('{"@type":"Other"}') + "\n```", None, None),
    (4, "```html\n<p>1 GB</p>" + _LD.format("{") + "\n```", None, None),
    (5, "```html\n" + _CITED.format("12 GB 88 GB", "99 GB") + "\n```", None, None),
]


def draft_branches(spark, sf_dir):
    drafts = spark.createDataFrame(DRAFTS, "id int, draft string, question string, self_host string")
    sources = spark.createDataFrame([("https://s.org/1", 200, "12 and 1300 and 5")], "url string, status int, text string")
    return draft_lane.draft_items(drafts, sources, spark.createDataFrame([], "id int, density double")).select("id", "W2", "W3", "W5", "W6", "W8")


def draft_scorecard(spark, sf_dir):
    drafts = spark.createDataFrame(DRAFTS, "id int, draft string, question string, self_host string")
    sources = spark.createDataFrame([("https://s.org/1", 200, "12 and 1300 and 5")], "url string, status int, text string")
    wide = draft_lane.draft_items(drafts, sources, spark.createDataFrame([], "id int, density double"))
    card = rubric.scorecard(rubric.long_scores(wide, "id", list(rubric.WRITE_WEIGHTS)), rubric.rubric(spark, rubric.WRITE_WEIGHTS))
    return card.select(F.col("entity").alias("id"), "failed_gates", "unobserved", "verdict")


def rubric_lines(spark, sf_dir):
    return reports.rubric_lines(rubric.rubric(spark)).where("nth < 3")


def html_reports(spark, sf_dir):
    cards = spark.createDataFrame([("a<b&c", 5, 9, "REWORK", "", "C1", "T1,T2"), ("d", 0, 0, "PASS", None, "", "")], "entity string, got int, full int, verdict string, failed_gates string, below_floor string, unobserved string")
    return reports.html_reports(cards)


def run_changes(spark, sf_dir):
    """Two runs whose items are not all in both."""
    old = spark.createDataFrame([("p", "C1", 3), ("p", "C2", 1), ("p", "C3", None), ("p", "C4", None), ("p", "T1", 2)], "entity string, item string, score int")
    new = spark.createDataFrame([("p", "C1", 2), ("p", "C2", 3), ("p", "C3", None), ("p", "C4", 0), ("p", "T1", 2), ("p", "T2", 1)], "entity string, item string, score int")
    return R.compare_runs(old, new).select("item", "old", "new", "change")


_QUERIES = [
    robots_observation, robots_groups, robots_rule_lines, blocked_classes, robots_sitemap_lines, robots_noindex_lines, blocked_by_server, index_gate_of_robots,
    sitemap_discovery, sitemap_found_in_crawl, sitemap_parse, sitemap_limits, lastmod_dates, joined_links, origins, inline_audit_items, jsonld_types, jsonld_values,
    jsonld_consistency, page_images, external_domains, winner_pages, noindex_of_answers, decoded_answers, entry_points, evidence_scorecard, site_topics, bench_gaps, inline_topics, topic_pages, inline_bench,
    fix_lookup, next_fix, fix_first, check_commands, meta_branches, meta_scorecard, draft_block_extract, draft_branches, draft_scorecard, rubric_lines, html_reports, run_changes,
]
