"""Queries of sites, drafts, titles, evidence, fixes and stored answers over the tables, with what these lack derived by id."""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .derived_queries import _addresses, _robots, spliced
from .functions import text as T
from .functions import urls as U
from .operators import crawl as C
from .operators import probes as P
from .operators import relational as R
from .operators import teardown as D
from .operators.order_statistics import first_rows
from .operators.ordering import checkpoint_dir
from .plans import draft_lane, evidence, fixes, meta_lane, page_audit, rubric, site_items
from .sinks import reports
from .sources import answers
from .sources.responses import decoded, in_slices
from .site_queries import MINE
from .sources.tables import pages, reach, table


def _one_of(key: Column, *values) -> Column:
    """The value at key modulo their number."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


# --- addresses -------------------------------------------------------------------------------------------------------

#: Dates by page_id, and whether each is one.
DATES = [
    ("2026-08-20", True), ("2026-8-2", True), ("2026-13-45", False), ("2026-02-30", False), ("2026-08-20T10:00:00", True), ("2026-08-20T10:00:00Z", True), ("2026-08-20T10:00:00+08:00", True), ("2026-08-20T10:00:00+0800", True),
    ("2026-08-20T10:00:00.5Z", True), ("2026-08-20T10:00:00.5", False), ("2026-08-20T10:00Z", True), ("2026-08-20T10:00", False), ("2026-08-20T25:00:00", False), ("20.08.2026", False), ("2026-08", False), (" 2026-08-20\t", True), ("", False),
]


def page_lastmod_dates(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", _one_of(F.col("page_id"), *(d for d, _ in DATES)).alias("lastmod"))
    return p.select("page_id", "lastmod", C.is_date(F.col("lastmod")).alias("valid"))


def page_joined_links(spark, sf_dir):
    """What links of eight kinds on a page mean."""
    k, url = F.col("page_id"), F.col("url")
    link = _one_of(k, "https://o.org/x", F.concat(F.lit("//cdn.net/"), k), F.concat(F.lit(" /root?q="), k, F.lit("\t")), F.concat(F.lit("page"), k, F.lit(".html")), F.concat(F.lit("../up/./"), k), F.concat(F.lit("?only="), k), "#part", "mailto:a@b.c")
    return table(spark, sf_dir, "pages").select("page_id", U.joined(url, link).alias("joined"))


def page_source_tier(spark, sf_dir):
    k, site = F.col("page_id"), F.col("site")
    source = _one_of(k, F.concat(F.lit("https://www.cdc.gov/"), k), F.concat(F.lit("https://arxiv.org/abs/"), k), F.concat(F.lit("https://medium.com/"), k), F.concat(F.lit("https://www."), site, F.lit("/own")), F.concat(F.lit("https://docs.k"), k, F.lit(".com/")), F.concat(F.lit("http://shop"), k, F.lit(".org:8080/p")))
    return _addresses(spark, sf_dir).select("page_id", U.source_tier(source, site).alias("tier"))


# --- sites -----------------------------------------------------------------------------------------------------------


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, its number of letters (n), least page (first) and origin."""
    return _addresses(spark, sf_dir).groupBy("site").agg(F.min("page_id").alias("first")).select("site", F.length("site").alias("n"), "first", F.concat(F.lit("https://"), F.col("site")).alias("origin"))


def _entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    each = sites.select("site", "n", "first", F.posexplode(F.array(*map(F.lit, ("http://", "http://www.", "https://", "https://www.")))).alias("v", "begin"))
    url = F.concat("begin", "site")
    status = _one_of(F.col("n") + F.col("v") * F.col("first"), 200, 200, 403, None, 200)
    final = _one_of(F.col("first") + F.col("v") * (F.col("n") % 2), F.concat(F.lit("https://"), F.col("site"), F.lit("/")), F.concat(F.lit("https://"), F.upper("site"), F.lit(":443")), url)
    return P.entry_points(sites, each.select(url.alias("url"), final.alias("final"), status.alias("status")))


def site_entry_points(spark, sf_dir):
    return _entry_points(spark, sf_dir)


def site_variant_landings(spark, sf_dir):
    return P.variant_landings(_entry_points(spark, sf_dir))


_SET, _MAP_ENTRIES = "<?xml version='1.0'?><urlset>{}</urlset>", 40


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, body): sitemaps by the length of a site's name modulo 3: one of its first pages, an index, or none."""
    sites = _sites(spark, sf_dir)
    entry = F.concat(F.lit("<url><loc> "), T.escaped(F.col("url")), F.lit(" </loc>"), F.when(F.col("page_id") % 2 == 0, "<lastmod>2026-08-20</lastmod>").otherwise(""), F.lit("</url>"))
    listed = first_rows(_addresses(spark, sf_dir).where(~F.col("url").contains("<")), ["site"], ["page_id"], _MAP_ENTRIES).select("site", "nth", entry.alias("entry"))
    listed = listed.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "entry"))), lambda e: e["entry"]), "").alias("entries"))  # _MAP_ENTRIES a site
    sites = sites.join(listed, "site", "left")
    at = lambda name: F.concat("origin", F.lit(name))
    kind = F.col("n") % 3
    children = F.concat(*(F.concat(F.lit("<sitemap><loc>"), at(f"/{k}.xml"), F.lit("</loc></sitemap>")) for k in range(4)))
    parts = _SET.split("{}")
    files = F.array(
        F.struct(at("/sitemap.xml").alias("url"), F.when(kind == 2, 404).otherwise(200).alias("status"), F.when(kind == 0, F.concat(F.lit(parts[0]), F.coalesce("entries", F.lit("")), F.lit(parts[1]))).when(kind == 1, "<HTML><body>&lt;urlset</body></html>").alias("body")),
        F.struct(at("/sitemap_index.xml").alias("url"), F.when(kind == 1, 200).otherwise(503).alias("status"), F.when(kind == 1, F.concat(F.lit("<sitemapindex>"), children, F.lit("</sitemapindex>"))).alias("body")),
        F.struct(at("/0.xml").alias("url"), F.lit(200).alias("status"), F.concat(F.lit("<urlset><url><loc>"), at("/first"), F.lit("</loc></url><url><lastmod>2026</lastmod></url></urlset>")).alias("body")),
        F.struct(at("/1.xml").alias("url"), F.lit(500).alias("status"), F.lit(None).cast("string").alias("body")),
        F.struct(at("/2.xml").alias("url"), F.lit(200).alias("status"), F.lit("<urlset><loc>/loose</loc><loc>#frag</loc></urlset>").alias("body")),
        F.struct(at("/a.xml").alias("url"), F.when(F.col("first") % 2 == 0, 200).otherwise(404).alias("status"), F.lit(_SET.format("<url><loc>/declared</loc></url>")).alias("body")),
    )
    return sites.select(F.explode(files).alias("f")).select("f.*")


def _tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    declared = C.robots_sitemaps(C.observed_robots(_robots(_addresses(spark, sf_dir))))
    return C.tried_sitemaps(C.sitemap_candidates(sites.select("site", "origin"), declared), _crawl(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sitemap_files(C.chosen_sitemaps(_tried(spark, sf_dir)), _crawl(spark, sf_dir))


def site_sitemaps(spark, sf_dir):
    return C.chosen_sitemaps(_tried(spark, sf_dir))


def site_sitemap_found(spark, sf_dir):
    return site_items.sitemap_found(_tried(spark, sf_dir))


def site_sitemap_entries(spark, sf_dir):
    return C.sitemap_entries(_files(spark, sf_dir))


def site_sitemap_limits(spark, sf_dir):
    return C.sitemap_limits(_files(spark, sf_dir))


def sitemap_issue_examples(spark, sf_dir):
    """The first two entries with each issue, of the list of each site."""
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("site"), (-k).alias("pos"), F.when(k % 11 == 0, F.concat(F.lit("/rel/"), k)).otherwise(F.col("url")).alias("loc"), F.when(k % 3 == 1, F.concat(k, F.lit(".01.2026"))).otherwise("2026-01-02").alias("lastmod"))
    return C.issue_examples(p)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.terms(F.concat_ws(" ", T.title(F.col("html")), F.array_join(T.distinct_tags(F.col("html"), "h1"), " ")))
    return pages(spark, sf_dir).select(U.bare_host(F.col("url")).alias("site"), "page_id", F.explode(found).alias("term"))


def title_classes(spark, sf_dir):
    """Which pages of a site have the same terms in title and h1, and how many."""
    classes, members, _ = R.similar_classes(_terms(spark, sf_dir))
    return members.join(classes, ["site", "class"]).select("site", "page_id", "class", "n_pages")


def title_class_links(spark, sf_dir):
    _, _, links = R.similar_classes(_terms(spark, sf_dir))
    return links.withColumn("jaccard", F.round("jaccard", 9))


# --- pages -----------------------------------------------------------------------------------------------------------


def page_item_evidence(spark, sf_dir):
    """C2, C3, C4 and K2 of each page with what decided them; every thirteenth page was not observed."""
    p = pages(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 13 > 0, F.col("html")))
    told = evidence.item_evidence(page_audit.facts(p))
    return told.withColumn("evidence", F.array_join("evidence", "|"))


def page_meta_items(spark, sf_dir):
    """The meta lane of each page's title and description, with M7 against the other pages of its site."""
    h = F.col("html")
    p = spliced(spark, sf_dir).select("page_id", U.bare_host(F.col("url")).alias("site"), T.title(h).alias("title"), T.meta_description(h).alias("description"))
    items = meta_lane.meta_items(p.select(F.col("page_id").alias("id"), "title", "description", F.element_at(T.terms(F.col("title")), -1).alias("keyword"), F.lit("blog").alias("page_type")))
    return items.join(site_items.repeated_heads(p).withColumnRenamed("page_id", "id"), "id", "left")


_META_SHOWN = ["MG1", "M1", "M2", "M4", "M7", "C4"]


def page_meta_lengths(spark, sf_dir):
    return page_meta_items(spark, sf_dir).select("id", *_META_SHOWN)


def _card(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = page_audit.audit_items(page_audit.facts(pages(spark, sf_dir)))
    return rubric.scorecard(rubric.long_scores(wide, "page_id", page_audit.ITEMS), rubric.rubric(spark))


def page_exit_codes(spark, sf_dir):
    """What a command that judges the page ends with, in the audit and in the other lanes."""
    return _card(spark, sf_dir).select(F.col("entity").alias("page_id"), rubric.exit_code(F.col("verdict"), "audit").alias("audit"), rubric.exit_code(F.col("verdict"), "write").alias("write"))


def page_reports(spark, sf_dir):
    """A page of HTML for each scorecard, by its digest."""
    return reports.html_reports(_card(spark, sf_dir)).select(F.col("entity").alias("page_id"), F.sha2(F.col("html").cast("binary"), 256).alias("report_sha256"))


def page_fixes(spark, sf_dir):
    """The first thing to mend on each page, what to do about it and the command that checks it."""
    scores = rubric.long_scores(page_audit.audit_items(page_audit.facts(pages(spark, sf_dir))), "page_id", page_audit.ITEMS)
    fixed = fixes.with_fixes(scores.withColumn("fix_key", F.lit(None).cast("string")), rubric.rubric(spark), fixes.fix_table(spark))
    first = fixes.next_fix(fixed).withColumnRenamed("entity", "page_id")
    return first.join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id").select("page_id", "item", "fix", fixes.check_command(F.col("item"), F.col("url")).alias("command"))


# --- other sites -----------------------------------------------------------------------------------------------------


def rival_topics(spark, sf_dir):
    """Topics of the four other sites with most pages, of twelve evenly spaced pages each, that one's own twelve lack."""
    listed = pages(spark, sf_dir).select(U.bare_host(F.col("url")).alias("site"), "page_id", "url", "html")
    rivals = listed.groupBy("site").agg((-F.count(F.lit(1))).alias("pos"))
    seen = D.scanned_pages(listed.select("site", "page_id"), MINE, rivals)
    traits = D.page_traits(page_audit.facts(listed.join(seen.select("page_id"), "page_id", "left_semi").drop("site")))
    return D.topics(traits, MINE).withColumn("density", F.round("density", 9))


def page_winners(spark, sf_dir):
    """What a writer takes from each page."""
    told = D.winner_pages(page_audit.facts(pages(spark, sf_dir)))
    return told.select("page_id", "observed", "n_blocks", "n_fact_blocks", F.array_join("quotable", "|").alias("quotable"), F.array_join("questions", "|").alias("questions"))


# --- drafts ----------------------------------------------------------------------------------------------------------


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, draft, question and self_host of each document as a draft, with links, media, checks and open points by doc_id."""
    k = F.col("doc_id")
    html = F.concat(
        F.lit("<p>"), T.escaped(F.coalesce("text", F.lit(""))), F.lit("</p>"),
        _one_of(k, "", "<p>They say amazing things.</p><p>It is the best ever.</p>", "<p>Plain.</p>"),
        _one_of(k, "", "<a href='/a'>a</a><a href='/b'>b</a><a href='/a'>a</a>", "<a href='/a'>a</a><a href='/b'>b</a><a href='/c'>c</a>", "<a href='/1'>1</a><a href='/2'>2</a><a href='/3'>3</a><a href='/4'>4</a><a href='/5'>5</a>"),
        _one_of(k, "", "<img src='a.png'>", "<img src='a.png' alt='a'><figcaption>A</figcaption>"),
        _one_of(k, "", '<script type="application/ld+json">{"@type":["ImageObject","HowTo"]}</script>', '<script type="application/ld+json">{"@type":"Article",}</script>', '<script type="application/ld+json">{"@type":"Other"}</script>', '<script type="application/ld+json">{</script>'),
        _one_of(k, "", "<p>Open [待核]</p>"),
    )
    kind = _one_of(k, "html", "markdown", "md")
    draft = F.concat(F.lit("# Draft\n"), _one_of(k, "", "```bash\ncurl -s https://a.org\n```\n", "```bash\necho done\n```\n"), F.lit("```"), kind, F.lit("\n"), html, F.lit("\n```\n"), _one_of(k, "", "## Needs review\n- open [待核]\n", "## Needs review\n", "## Other\n- [待核]\n"))
    return table(spark, sf_dir, "documents").select(k.alias("id"), F.when(k % 10 > 0, draft).alias("draft"), F.lit(None).cast("string").alias("question"), F.lit("own.org").alias("self_host"))


def document_draft_blocks(spark, sf_dir):
    block = draft_lane.content_block(F.col("draft"))
    return _drafts(spark, sf_dir).select(F.col("id").alias("doc_id"), F.sha2(block.cast("binary"), 256).alias("block_sha256"))


def _no_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "url string, status int, text string")


def document_draft_items(spark, sf_dir):
    told = draft_lane.draft_items(_drafts(spark, sf_dir), _no_sources(spark), spark.createDataFrame([], "id long, density double"))
    return told.select(F.col("id").alias("doc_id"), "C4", "W6", "W8", "W9", "D1", "D2")


def page_draft_line(spark, sf_dir):
    """W1 of each page as a draft, its line drawn by the first five other pages of its site, as the bench of winners does it."""
    h, url = F.col("html"), F.col("url")
    facts = page_audit.facts(pages(spark, sf_dir)).select("site", "page_id", F.coalesce(F.size(F.filter("blocks", T.has_fact)) / F.nullif(F.size("blocks"), F.lit(0)), F.lit(0.0)).alias("density"))
    first = first_rows(facts, ["site"], ["page_id"], 6).select("site", F.col("page_id").alias("other"), "density")
    own = _addresses(spark, sf_dir).select("site", F.col("page_id").alias("id"))
    near = first_rows(own.join(first, "site").where("id <> other"), ["id"], ["other"], 5).select("id", "density")
    drafts = pages(spark, sf_dir).select(F.col("page_id").alias("id"), h.alias("draft"), h.alias("block"), F.lit(None).cast("string").alias("question"), U.bare_host(url).alias("self_host"))
    return draft_lane.draft_items(drafts, _no_sources(spark), near).select(F.col("id").alias("page_id"), "W1")


# --- stored answers --------------------------------------------------------------------------------------------------


def _pack(raw: bytes | None) -> bytes | None:
    if raw is None:
        return None
    c = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return c.compress(raw) + c.flush()


@F.arrow_udf(BinaryType())
def _packed(raw: pa.Array) -> pa.Array:
    """Bodies as a server packs them."""
    return in_slices(_pack, pa.binary(), raw)


def page_answers(spark, sf_dir):
    """The pages stored as raw answers, packed and in several character sets, and read back: status, reach and digest of the text."""
    answers.register(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    k, html = F.col("page_id"), F.col("html")
    wide = k % 3 == 0
    raw = F.when(wide, F.encode(html, "UTF-16LE")).otherwise(F.encode(html, "UTF-8"))
    packed = k % 2 == 0
    headers = F.map_filter(F.create_map(F.lit("content-type"), F.when(wide, "text/html; charset=UTF-16LE").otherwise("text/html; charset=utf-8"), F.lit("content-encoding"), F.when(packed, "gzip"), F.lit("x-page"), k.cast("string")), lambda _, v: v.isNotNull())
    status = _one_of(k, 200, 200, 403, 200, None)
    p = pages(spark, sf_dir).select(U.bare_host(F.col("url")).alias("host"), "url", F.col("url").alias("final_url"), status.alias("status"), headers.alias("headers"), F.when(status.isNotNull(), F.when(packed, _packed(raw)).otherwise(raw)).alias("body"), F.when(status.isNull(), "timed out").alias("error"))
    p.repartition("host").write.format("stored_answers").mode("append").save(path)
    found = spark.read.format("stored_answers").load(path)
    text = decoded(F.col("body"), F.col("headers")["content-encoding"], F.col("headers")["content-type"])
    return found.select(F.col("headers")["x-page"].cast("long").alias("page_id"), "host", "status", reach(F.col("status")).alias("reach"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), "error")


_QUERIES = [
    page_lastmod_dates, page_joined_links, page_source_tier, site_entry_points, site_variant_landings, site_sitemaps, site_sitemap_found, site_sitemap_entries, site_sitemap_limits, sitemap_issue_examples, title_classes,
    title_class_links, page_item_evidence, page_meta_lengths, page_exit_codes, page_reports, page_fixes, rival_topics, page_winners, document_draft_blocks, document_draft_items, page_draft_line, page_answers,
]
