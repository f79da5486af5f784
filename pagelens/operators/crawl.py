"""Operators over robots rules, sitemaps, probes and redirects of many sites at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import stripped
from ..sources.tables import reach
from .order_statistics import first_rows
from .robots_index import page_verdicts

# Where sitemaps are looked for, how large they may be, and how much of them is read; agents by class.
CANDIDATES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap")
MAX_ENTRIES, MAX_BYTES, MAX_CHILDREN, MAX_URLS = 50_000, 50 * 1024 * 1024, 3, 2000
LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
AGENTS = {
    "search": ["Googlebot", "Bingbot"],
    "ai_search": ["OAI-SearchBot", "Claude-SearchBot", "PerplexityBot"],
    "ai_user": ["ChatGPT-User", "Claude-User", "Perplexity-User"],
    "training": ["GPTBot", "ClaudeBot", "CCBot", "Google-Extended"],
}


def observed_robots(robots: DataFrame) -> DataFrame:
    """(site, observed, body, reason) of (site, status, body): what the answer for robots.txt says about the rules.

    A missing or blank file allows everything and is an observation; a refusal, a failure or an HTML page is none.
    """
    state, text = reach(F.col("status")), F.coalesce("body", F.lit(""))
    reason = (
        F.when(F.coalesce(F.col("status") == 404, F.lit(False)), "no file")
        .when(state != "ok", "not fetched")
        .when(F.lower(F.substring(text, 1, 400)).contains("<html"), "html")
        .when(~text.rlike(r"\S"), "blank")
        .otherwise("rules")
    )
    seen = robots.select("site", reason.alias("reason"), text.alias("text"))
    return seen.select("site", F.col("reason").isin("no file", "blank", "rules").alias("observed"), F.when(F.col("reason") == "rules", F.col("text")).otherwise("").alias("body"), "reason")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(site, pos, line): the sitemaps that the rules of (site, body) declare, in order."""
    return robots.select("site", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))).alias("pos", "line"))


def robots_noindex(robots: DataFrame) -> DataFrame:
    """(site, path): noindex lines, which no crawler heeds."""
    return robots.select("site", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*noindex\s*:\s*(\S+)"), F.lit(1))).alias("path"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """(site, grp, agent, pos, kind, value): each rule of (site, body) under each agent of its group.

    A group begins at a user-agent line whose previous kept line is none; lines before the first belong nowhere, and
    lines without a colon say nothing.
    """
    lines = robots.select("site", F.posexplode(F.split("body", LINE_ENDS)).alias("pos", "line"))
    lines = lines.select("site", "pos", stripped(F.regexp_replace("line", "#.*$", "")).alias("part")).where(F.col("part").contains(":"))
    lines = lines.select("site", "pos", F.lower(stripped(F.split_part("part", F.lit(":"), F.lit(1)))).alias("key"), stripped(F.regexp_replace("part", "^[^:]*:", "")).alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("site").orderBy("pos")
    fresh = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("fresh", fresh.cast("int")).withColumn("grp", F.sum("fresh").over(order)).where("grp > 0")
    agents = lines.where("key = 'user-agent'").select("site", "grp", F.lower("value").alias("agent"))
    rules = lines.where("key <> 'user-agent'").select("site", "grp", "pos", F.col("key").alias("kind"), "value")
    return agents.distinct().join(rules, ["site", "grp"], "left")


def robots_decisions(robots: DataFrame, agents: DataFrame, path: str = "/") -> DataFrame:
    """(site, agent, grp_kind, allowed, rule) of one path at each site; ``robots_index.page_verdicts`` tells it of each page's own.

    rule is the line that decides, NULL if none matches.
    """
    asked = robots.select("site", F.lit(0).alias("page"), F.lit(path).alias("path")).distinct()
    return page_verdicts(robots, robots_rules(robots), asked, agents).drop("page")


def agent_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, a) for c, names in AGENTS.items() for a in names], "class string, agent string")


def robots_classes(robots: DataFrame) -> DataFrame:
    """(site, class, allowed, blocked) of observed (site, status, body): whether all agents of a class may come, and which may not."""
    seen = observed_robots(robots).where("observed").select("site", "body")
    agents = agent_table(robots.sparkSession)
    told = robots_decisions(seen, agents.select("agent")).join(F.broadcast(agents), "agent")  # twelve agents
    blocked = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("allowed"), F.col("agent")))), ",")
    return told.groupBy("site", "class").agg(F.bool_and("allowed").alias("allowed"), blocked.alias("blocked"))


def blocked_by_server(probes: DataFrame) -> DataFrame:
    """(site, agents) of (site, agent, status), NULL being the browser's row: agents that are turned away where a browser is not.

    Sites that turn the browser away too, or do not answer, are left out: there is nothing to compare with.
    """
    state = reach(F.col("status"))
    agents = F.array_join(F.array_sort(F.collect_list(F.when(F.col("agent").isNotNull() & (state == "blocked"), F.col("agent")))), ",")
    told = probes.groupBy("site").agg(F.bool_or(F.col("agent").isNull() & (state == "ok")).alias("open"), agents.alias("agents"))
    return told.where("open").select("site", "agents")


def is_sitemap(body: Column) -> Column:
    """Whether an answer is a sitemap and no page that stands in for one."""
    head = F.lower(F.substring(body, 1, 3000))
    return ~F.substring(head, 1, 400).contains("<html") & (head.contains("<urlset") | head.contains("<sitemapindex"))


def sitemap_candidates(sites: DataFrame, declared: DataFrame) -> DataFrame:
    """(site, pos, url, declared) of (site, origin) and (site, pos, line): where a sitemap may be, each address once.

    Only lines with an absolute address count as declared.
    """
    own = declared.join(sites, "site").select("site", "pos", U.joined(F.concat("origin", F.lit("/")), F.col("line")).alias("url"), F.col("line").startswith("http").alias("declared"))
    usual = sites.select("site", "origin", F.posexplode(F.array(*map(F.lit, CANDIDATES))).alias("pos", "path"))
    usual = usual.select("site", (F.col("pos") + 1_000_000).alias("pos"), F.concat("origin", "path").alias("url"), F.lit(False).alias("declared"))
    return own.unionByName(usual).groupBy("site", "url").agg(F.min("pos").alias("pos"), F.bool_or("declared").alias("declared")).select("site", "pos", "url", "declared")


def tried_sitemaps(candidates: DataFrame, crawl: DataFrame) -> DataFrame:
    """(site, pos, url, declared, status, usable): candidates with the answers of (url, status, body)."""
    answers = crawl.select("url", "status", (F.coalesce(is_sitemap(F.col("body")), F.lit(False)) & (reach(F.col("status")) == "ok")).alias("usable"))
    return candidates.join(answers, "url", "left").select("site", "pos", "url", "declared", "status", F.coalesce("usable", F.lit(False)).alias("usable"))


def chosen_sitemaps(tried: DataFrame) -> DataFrame:
    """(site, url): the first usable candidate of each site that has one."""
    return tried.where("usable").groupBy("site").agg(F.min_by("url", "pos").alias("url"))


def sitemap_files(chosen: DataFrame, crawl: DataFrame) -> DataFrame:
    """(site, nth, url, status, body, children): each site's sitemap, or the first children of its index in their place."""
    top = chosen.join(crawl, "url").select("site", "url", "status", "body", F.lower(F.substring("body", 1, 3000)).contains("<sitemapindex").alias("is_index"))
    found = F.regexp_extract_all("body", F.lit(r"(?is)<sitemap>.*?<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    parts = top.where("is_index").select("site", found.alias("c")).select("site", F.size("c").alias("children"), F.posexplode(F.slice("c", 1, MAX_CHILDREN)).alias("nth", "url"))
    parts = parts.join(crawl, "url", "left").select("site", "nth", "url", "status", "body", "children")
    return top.where("not is_index").select("site", F.lit(0).alias("nth"), "url", "status", "body", F.lit(0).alias("children")).unionByName(parts)


def _entries(body: Column) -> Column:
    """array<struct<loc, lastmod>> of a sitemap's url elements; of one without any, all of its addresses."""
    loc, when = r"(?is)<loc>\s*([^<]+?)\s*</loc>", r"(?is)<lastmod>\s*([^<]+?)\s*</lastmod>"
    some = lambda u, p: F.when(u.rlike(p), F.regexp_extract(u, p, 1))
    named = F.filter(F.transform(F.regexp_extract_all(body, F.lit("(?is)<url>(.*?)</url>"), F.lit(1)), lambda u: F.struct(some(u, loc).alias("loc"), some(u, when).alias("lastmod"))), lambda e: e["loc"].isNotNull())
    loose = F.transform(F.regexp_extract_all(body, F.lit(loc), F.lit(1)), lambda x: F.struct(x.alias("loc"), F.lit(None).cast("string").alias("lastmod")))
    return F.when(F.size(named) > 0, named).otherwise(loose)


def sitemap_entries(files: DataFrame, most: int = MAX_URLS) -> DataFrame:
    """(site, pos, loc, lastmod) from (site, nth, status, body), file by file; the first ``most`` of a site, as the audit reads no more."""
    each = files.where(reach(F.col("status")) == "ok").select("site", "nth", F.posexplode(_entries(F.col("body"))).alias("at", "e"))
    sizes = each.groupBy("site", "nth").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("site").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)  # MAX_CHILDREN files at most
    begins = sizes.select("site", "nth", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    placed = each.join(begins, ["site", "nth"]).select("site", (F.col("begin") + F.col("at")).cast("int").alias("pos"), "e.loc", "e.lastmod")
    return placed.where(F.col("pos") < most)


def sitemap_limits(files: DataFrame) -> DataFrame:
    """(site, issue) of (site, nth, url, status, body, children): what is too large, cut off or out of reach."""
    ok, single = reach(F.col("status")) == "ok", F.col("children") == 0
    issues = F.array(
        F.when(single & (F.octet_length("body") > MAX_BYTES), F.lit("size")),
        F.when(single & ok & (F.size(_entries(F.col("body"))) > MAX_ENTRIES), F.lit("too_many")),
        F.when(F.col("children") > MAX_CHILDREN, F.lit("index_truncated")),
        F.when(~single & ~F.coalesce(ok, F.lit(False)), F.lit("child_unreachable")),
    )
    return files.select("site", F.explode(F.array_compact(issues)).alias("issue")).distinct()


def is_date(text: Column) -> Column:
    """A W3C date, or a date and time with seconds; a fraction needs a zone, and so does a time without seconds."""
    text = stripped(text)
    day = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2})(?:T|$)", 1), F.lit("yyyy-M-d")).isNotNull()
    zone = r"(?:Z|[+-]\d{2}:?[0-5]\d)"
    timed = text.rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:T(?:[01]?\d|2[0-3]):[0-5]?\d:(?:[0-5]?\d|6[01])(?:{zone}|\.\d{{1,6}}{zone})?)?$")
    loose = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?(?:[+-]\d{2}:\d{2}|Z)$")
    return F.coalesce((day & timed) | loose, F.lit(False))


def _issues(site: Column) -> dict[str, Column]:
    """The tests of an entry (loc, lastmod) for each kind of issue that has examples."""
    loc, when = F.col("loc"), F.nullif("lastmod", F.lit(""))
    absolute = loc.rlike("^https?://")
    host = F.regexp_replace(F.regexp_extract(F.lower(loc), r"^https?://([^/?#:]*)", 1), r"^www\.", "")
    return {"relative": ~absolute, "cross_host": absolute & (host != site), "fragment": loc.contains("#"), "lastmod_format": when.isNotNull() & ~is_date(when)}


def issue_examples(entries: DataFrame, k: int = 2) -> DataFrame:
    """(site, issue, nth, example): the first k entries of (site, pos, loc, lastmod) with each issue, by their place in the list."""
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("issue"), (F.col("lastmod") if name == "lastmod_format" else F.col("loc")).alias("example"))) for name, test in _issues(F.col("site")).items())))
    rows = entries.select("site", "pos", F.explode(found).alias("i")).select("site", "i.issue", "pos", "i.example")
    return first_rows(rows, ["site", "issue"], ["pos", "example"], k).select("site", "issue", "nth", "example")


def sitemap_hygiene(entries: DataFrame) -> DataFrame:
    """Counts of each kind of issue of a site's entries, with up to two examples of each, in one aggregate."""
    loc, when = F.col("loc"), F.nullif("lastmod", F.lit(""))
    host = F.regexp_replace(F.regexp_extract(F.lower(loc), r"^https?://([^/?#:]*)", 1), r"^www\.", "")
    absolute = loc.rlike("^https?://")
    kinds = {"relative": ~absolute, "cross_host": absolute & (host != F.col("site")), "fragment": loc.contains("#"), "lastmod_format": when.isNotNull() & ~is_date(when)}
    shown = {k: F.col("lastmod") if k == "lastmod_format" else loc for k in kinds}
    told = entries.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(test).alias(k) for k, test in kinds.items()),
        (F.count_distinct(F.when(absolute, F.regexp_extract(loc, "^(https?)", 1))) > 1).alias("mixed_scheme"),
        ((F.count(F.lit(1)) >= 5) & (F.count(when) == F.count(F.lit(1))) & (F.count_distinct(when) == 1)).alias("lastmod_uniform"),
        *(F.array_compact(F.array(F.min(F.when(test, shown[k])), F.nullif(F.max(F.when(test, shown[k])), F.min(F.when(test, shown[k]))))).alias(f"{k}_examples") for k, test in kinds.items()),
    )
    return told

