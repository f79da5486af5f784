"""Queries over the web-page tables and inline rows, and the SQL that says what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived_lanes, derived_queries, site_queries
from .functions import text as T
from .functions import urls as U
from .operators import crawl as C
from .operators import redirects
from .operators.order_statistics import exact_medians
from .operators.ordering import settled
from .operators import probes as P
from .operators import relational as R
from .plans import draft_lane, meta_lane, page_audit, rubric, site_items
from .sources.tables import pages, reach, table

# --- pages -----------------------------------------------------------------------------------------------------------


def page_clean_text_stats(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", T.clean_text(F.col("html")).alias("t"))
    return p.select("page_id", F.char_length("t").alias("n_chars"), F.size(T.words(F.col("t"))).alias("n_words"))


def page_head_facts(spark, sf_dir):
    h = F.col("html")
    return pages(spark, sf_dir).select("page_id", T.title(h).alias("title"), T.lang(h).alias("lang"), T.meta_description(h).alias("description"), F.size(T.tags(h, "h1")).alias("h1_count"))


def page_link_counts(spark, sf_dir):
    h, host = F.col("html"), U.bare_host(F.col("url"))
    return pages(spark, sf_dir).select("page_id", F.size(T.internal_links(h, host)).alias("n_internal"), F.size(T.external_links(h, host)).alias("n_external"))


def page_structure_counts(spark, sf_dir):
    return page_audit.facts(pages(spark, sf_dir)).select("page_id", "n_lists", "n_tables", "n_images")


def page_blocks(spark, sf_dir):
    b = pages(spark, sf_dir).select("page_id", F.posexplode(T.blocks(F.col("html"))).alias("pos", "b"))
    return b.select("page_id", "pos", F.col("b.tag").alias("tag"), F.col("b.text").alias("text"))


def first_50_words(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.first_words(T.clean_text(F.col("html"))).alias("first"))


def nav_word_share(spark, sf_dir):
    p = page_audit.facts(pages(spark, sf_dir)).select("page_id", F.slice("words", 1, 50).alias("w"), "nav")
    return p.select("page_id", F.size(F.filter("w", lambda x: F.array_contains(F.col("nav"), F.lower(x)))).alias("in_nav"), F.size("w").alias("n"))


def title_terms(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.array_join(F.array_sort(T.terms(T.title(F.col("html")))), ",").alias("terms"))


def sentence_extract(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.regexp_replace("text", r"\s+", " ")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.size(F.filter("s", lambda x: x.rlike("[0-9]"))).alias("n_with_number"))


def fact_density_by_page(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", T.blocks(F.col("html")).alias("b"))
    return p.select("page_id", F.size("b").alias("n_blocks"), F.size(F.filter("b", T.is_fact)).alias("n_facts"))


# --- addresses -------------------------------------------------------------------------------------------------------


def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.bare_host(u).alias("host"), U.norm_url(u).alias("norm"), U.lang_segment(u).alias("segment"), F.array_join(T.terms(F.regexp_replace(U.path(u), "[-_/]", " ")), " ").alias("path_terms"))


_SOURCES = ["https://www.cdc.gov/flu", "https://arxiv.org/abs/1", "https://medium.com/x", "http://blog.example.org/a", "https://docs.example.com/", "https://shop.example.org:8080/p"]


def source_tier(spark, sf_dir):
    rows = spark.createDataFrame([(u,) for u in _SOURCES], "url string")
    return rows.select("url", U.source_tier(F.col("url"), F.lit("shop.example.org")).alias("tier"))


# --- sites -----------------------------------------------------------------------------------------------------------


def _terms(spark, sf_dir):
    p = pages(spark, sf_dir)
    found = T.terms(F.concat_ws(" ", T.title(F.col("html")), F.array_join(T.distinct_tags(F.col("html"), "h1"), " ")))
    return p.select(U.bare_host(F.col("url")).alias("site"), "page_id", F.explode(found).alias("term"))


def term_coverage(spark, sf_dir):
    return R.term_coverage(_terms(spark, sf_dir))


def topic_gaps(spark, sf_dir):
    coverage = R.term_coverage(_terms(spark, sf_dir))
    noise = spark.createDataFrame([("min",), ("sec",), ("tool",), ("page",)], "term string")
    return R.topic_gaps(coverage, "ththth.example.net", F.broadcast(noise))


def title_keyword_clash(spark, sf_dir):
    return R.similar_pairs(_terms(spark, sf_dir)).select("site", "a", "b", F.round("jaccard", 9).alias("jaccard"))


def duplicate_titles(spark, sf_dir):
    t = pages(spark, sf_dir).select("page_id", T.title(F.col("html")).alias("title"))
    return t.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


def systematic_sample(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("site"), "page_id")
    return R.systematic_sample(p, "site", "page_id", 5)


def bench_summary(spark, sf_dir):
    f = page_audit.facts(pages(spark, sf_dir)).select("site", F.size("words").alias("n_words"), "n_lists", "n_tables", "n_images", (F.size(F.filter("blocks", T.is_fact)) / F.nullif(F.size("blocks"), F.lit(0))).alias("density"))
    f = settled(f)
    medians = exact_medians(f, ["site"], ["n_words", "density"]).select("site", F.col("n_words").cast("long").alias("median_words"), F.round("density", 9).alias("median_density"))
    told = f.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("n_lists") > 0).alias("with_lists"), F.count_if(F.col("n_tables") > 0).alias("with_tables"), F.count_if(F.col("n_images") > 0).alias("with_images"))
    return told.join(medians, "site", "left")


# --- scores ----------------------------------------------------------------------------------------------------------


def _scores(spark, sf_dir):
    return rubric.long_scores(page_audit.audit_items(page_audit.facts(pages(spark, sf_dir))), "page_id", page_audit.ITEMS)


def audit_items(spark, sf_dir):
    return page_audit.audit_items(page_audit.facts(pages(spark, sf_dir)))


def _all_scores(spark, sf_dir):
    """Every item of the rubric; those on probes, robots rules, sitemaps and redirects have no table here and are unobserved."""
    items = list(rubric.AUDIT_WEIGHTS)
    wide = page_audit.all_items(pages(spark, sf_dir), [], [], items, overlap=True)
    return rubric.long_scores(wide, "page_id", items)


def _card(spark, scores):
    card = rubric.scorecard(scores, rubric.rubric(spark))
    return card.select(F.col("entity").alias("page_id"), "got", "full", "failed_gates", "below_floor", "unobserved", F.round("ratio", 9).alias("ratio"), "verdict")


def _action(spark, scores):
    return rubric.next_action(scores, rubric.rubric(spark)).select(F.col("entity").alias("page_id"), "item")


def lane_scorecard(spark, sf_dir):
    return _card(spark, _scores(spark, sf_dir))


def next_action(spark, sf_dir):
    return _action(spark, _scores(spark, sf_dir))


def full_scorecard(spark, sf_dir):
    return _card(spark, _all_scores(spark, sf_dir))


def full_next_action(spark, sf_dir):
    return _action(spark, _all_scores(spark, sf_dir))


def _changes(scores):
    old = scores.where("entity % 2 = 0 or item <> 'C2'").withColumn("score", F.when(F.col("item").isin("C1", "I1"), F.col("score") - 1).when(F.col("item") == "I2", None).when((F.col("item") == "C2") & (F.col("score") < 3), F.col("score") + 1).otherwise(F.col("score")))
    return R.compare_runs(old, scores).groupBy("item", "change").agg(F.count(F.lit(1)).alias("n"))


def run_compare(spark, sf_dir):
    return _changes(_scores(spark, sf_dir))


def full_run_compare(spark, sf_dir):
    return _changes(_all_scores(spark, sf_dir))


_PAIRS = [
    (1, "Free PDF converter for teams", "Convert a PDF to PNG in 3 seconds, no sign-up needed. Export and download your files for free, as often as you like.", "pdf converter", "tool"),
    (2, "Short", "Too short", "pdf", "home"),
    (3, "Pricing of our amazing revolutionary editor suite", "From $9 / month. The best ever editor, amazing value and cutting-edge speed for developers and marketers everywhere.", "editor", "pricing"),
    (4, "A title without the wanted word at all, which is rather long for a title", "Words words words words words words words words words words words words words.", "converter", None),
    (5, None, None, None, "home"),
    (6, "Random word generator", "random word generator", "generator", "tool"),
]


def meta_items(spark, sf_dir):
    return meta_lane.meta_items(spark.createDataFrame(_PAIRS, "id int, title string, description string, keyword string, page_type string"))


# --- crawl -----------------------------------------------------------------------------------------------------------


def reach_class(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*map(F.lit, (200, 301, 403, 404, 410, 429, 500, None))), (F.col("page_id") % 8 + 1).cast("int")).alias("status")).select("page_id", reach(F.col("status")).alias("reach"))


_ROBOTS = [
    ("a", "User-agent: Googlebot\nDisallow: /x # no\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nUser-agent: *\nAllow: /\n"),
    ("b", "Disallow: /lost\nUser-agent: *\nDisallow: /\nAllow: /$\n"),
    ("c", ""),
    ("d", "User-agent: *\nDisallow: /*\n\nUser-agent: bingbot\nDisallow:\n"),
]


def robots_decision(spark, sf_dir):
    return C.robots_decisions(spark.createDataFrame(_ROBOTS, "site string, body string"), C.agent_table(spark).select("agent")).drop("rule")


def sitemap_hygiene(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("site"), F.when(F.col("page_id") % 11 == 0, "/rel").otherwise(F.col("url")).alias("loc"), F.when(F.col("page_id") % 3 == 0, "2026-01-02").when(F.col("page_id") % 3 == 1, "02.01.2026").alias("lastmod"))
    return C.sitemap_hygiene(p).select("site", "n", "relative", "cross_host", "fragment", "mixed_scheme", "lastmod_format", "lastmod_uniform")


_HOPS = [("http://a/", 301, "https://a/"), ("https://a/", 302, "https://a/home"), ("https://a/home", 200, None), ("https://loop/", 301, "https://loop/"), ("https://gone/", 404, None)]


def redirect_chain(spark, sf_dir):
    hops = spark.createDataFrame(_HOPS, "url string, status int, location string")
    return redirects.follow_redirects(hops.select(F.col("url").alias("start")), hops)


# --- phrases, lengths and probes -------------------------------------------------------------------------------------


def marketing_hits(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", T.blocks(F.col("html")).alias("b"))
    return p.select("page_id", F.aggregate("b", F.lit(0), lambda n, b: n + F.regexp_count(b["text"], F.lit(T.MARKETING_SCAN))).alias("hits"))


def dangling_paragraphs(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", T.blocks(F.col("html")).alias("b"))
    return p.select("page_id", F.size(F.filter("b", lambda b: b["tag"].isin("p", "blockquote") & b["text"].rlike(T.DANGLING))).alias("n_dangling"))


def fact_density_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\n+"), lambda x: x.rlike("[^ ]")).alias("x"))
    return d.select("doc_id", F.size("x").alias("n_lines"), F.size(F.filter("x", lambda x: x.rlike(T.FACT) | x.rlike(T.RANGE))).alias("n_facts"))


def lang_vs_url_segment(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", T.lang(F.col("html")).alias("lang"), U.lang_segment(F.col("url")).alias("segment"))
    return p.select("page_id", (F.lower(F.substring("lang", 1, 2)) == F.substring("segment", 1, 2)).alias("agrees"))


def title_length_class(spark, sf_dir):
    n = T.wide_length(T.title(F.col("html")))
    return pages(spark, sf_dir).select("page_id", n.alias("n")).select("page_id", "n", F.when(F.col("n") < 15, "short").when(F.col("n") <= 60, "good").when(F.col("n") > 60, "long").otherwise("none").alias("kind"))


_SIGNALS = [(1, "noindex, follow", None), (2, "index", "NoIndex"), (3, "NOINDEX", "noindex"), (4, None, None)]


def noindex_signals(spark, sf_dir):
    return P.noindex_signals(spark.createDataFrame(_SIGNALS, "id int, meta_robots string, header string"))


def sample_liveness(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, (200, 200, 200, 200, 403, 404))), (F.col("page_id") % 6 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("site"), F.when(F.col("page_id") % 7 > 0, status).alias("status"), (F.col("page_id") % 4 == 0).alias("redirected"))
    return P.sample_liveness(p)


_LANDINGS = [("a", "http", "https://a.com/"), ("a", "www", "https://a.com"), ("b", "http", "https://b.com/"), ("b", "www", None), ("b", "https", "https://B.com:443/"), ("c", "http", "http://c.com/"), ("c", "https", "https://c.com/"), ("d", "http", None), ("d", "https", "https://d.com/")]


def variant_landings(spark, sf_dir):
    return P.variant_landings(spark.createDataFrame(_LANDINGS, "site string, variant string, final string"))


# --- drafts ----------------------------------------------------------------------------------------------------------

_GOOD = (
    "# Draft\n```bash\ncurl -s https://www.cdc.gov/flu\n```\n## Needs review\n- price [待核]\n",
    "<p>Flu shots last 12 months for 1,500 people and they cost 30 USD, says <a href='https://www.cdc.gov/flu'>the agency</a>.</p><p>Shots are given in 3 minutes at any clinic near the station [待核].</p>"
    "<img src='a.png' alt='a shot'><figcaption>A shot</figcaption><a href='/a'>a</a><a href='/b'>b</a><a href='/c'>c</a>"
    '<script type="application/ld+json">{"@type":"Article","image":{"@type":"ImageObject"}}</script>',
    "how long do flu shots last",
)
_POOR = ("no section", "<p>They are fine.</p><p>It took 7 hours, see [a post](https://medium.com/x).</p>![](a.png) [待核]", None)
_DRAFTS = [(1, *_GOOD, "shop.example.org"), (2, *_POOR, "shop.example.org"), (3, None, None, "flu", None)]
_PROBED = [("https://www.cdc.gov/flu", 200, "12 months, 1500 people"), ("https://medium.com/x", 404, None)]
_COMPARABLE = [(1, 0.1), (1, 0.4), (1, 0.6), (1, 0.9), (2, 0.9), (3, None)]


def draft_items(spark, sf_dir):
    drafts = spark.createDataFrame(_DRAFTS, "id int, draft string, block string, question string, self_host string")
    return draft_lane.draft_items(drafts, spark.createDataFrame(_PROBED, "url string, status int, text string"), spark.createDataFrame(_COMPARABLE, "id int, density double"))


def page_draft_items(spark, sf_dir):
    """Every page as a draft that answers its own title, without comparable pages; what its sources say is made of their address."""
    h, url = F.col("html"), F.col("url")
    drafts = pages(spark, sf_dir).select(F.col("page_id").alias("id"), h.alias("draft"), h.alias("block"), T.title(h).alias("question"), U.bare_host(url).alias("self_host"))
    sources = pages(spark, sf_dir).select(F.explode(draft_lane.outside(h)).alias("url")).distinct()
    sources = sources.select("url", F.element_at(F.array(*map(F.lit, (200, 403, 404, None))), F.length("url") % 4 + 1).alias("status"), F.lit("12 and 2,500 and 30").alias("text"))
    return draft_lane.draft_items(drafts, sources, spark.createDataFrame([], "id long, density double")).select("id", "WG1", "W1", "W2", "W3", "W7", "W9", "D1")


# --- sites, item by item ---------------------------------------------------------------------------------------------


def reach_gate(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, (200, 301, 403, 404, None, 429, 503, 302))), (F.col("page_id") % 8 + 1).cast("int"))
    return site_items.reach_gate(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), status.alias("status")))


_ALLOWED = [("a", "search", True), ("a", "training", False), ("b", "ai_user", False), ("b", "search", True), ("c", "search", True)]


def index_gate(spark, sf_dir):
    return site_items.index_gate(spark.createDataFrame(_ALLOWED, "site string, class string, allowed boolean"), spark.createDataFrame([("c", "meta"), ("c", "header")], "site string, place string"))


_TRIED = [("a", 404, False, True), ("a", 200, True, True), ("b", 200, True, False), ("c", 404, False, False), ("c", 200, False, False), ("d", 404, False, False), ("d", 500, False, False), ("e", None, False, False), ("e", 404, False, False)]


def sitemap_found(spark, sf_dir):
    return site_items.sitemap_found(spark.createDataFrame(_TRIED, "site string, status int, usable boolean, declared boolean"))


def sitemap_score(spark, sf_dir):
    return site_items.sitemap_score(sitemap_hygiene(spark, sf_dir))


def canonical_landing(spark, sf_dir):
    return site_items.canonical_landing(redirect_chain(spark, sf_dir))


def declared_values(spark, sf_dir):
    return site_items.declared_values(pages(spark, sf_dir))


def keyword_overlap(spark, sf_dir):
    classes, _, links = R.similar_classes(_terms(spark, sf_dir))
    return site_items.keyword_overlap(R.alike_pages(classes, links), table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("site")))


def shared_term(spark, sf_dir):
    h = F.col("html")
    path = F.regexp_replace(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1), "[-_/]+", " ")
    return site_items.shared_term(pages(spark, sf_dir).select("page_id", T.title(h).alias("title"), F.array_join(T.tags(h, "h1"), " ").alias("h1"), path.alias("path"), F.get(T.sentences(T.clean_text(h)), F.lit(0)).alias("first")))


def repeated_heads(spark, sf_dir):
    h = F.col("html")
    return site_items.repeated_heads(pages(spark, sf_dir).select("page_id", U.bare_host(F.col("url")).alias("site"), T.title(h).alias("title"), T.meta_description(h).alias("description")))


_QUERIES = [
    page_clean_text_stats, page_head_facts, page_link_counts, page_structure_counts, page_blocks, first_50_words, nav_word_share, title_terms, sentence_extract, fact_density_by_page, url_parts,
    source_tier, term_coverage, topic_gaps, title_keyword_clash, duplicate_titles, systematic_sample, bench_summary, audit_items, lane_scorecard, next_action, run_compare, full_scorecard,
    full_next_action, full_run_compare, meta_items, reach_class, robots_decision, sitemap_hygiene, redirect_chain, marketing_hits, dangling_paragraphs, fact_density_docs, lang_vs_url_segment,
    title_length_class, noindex_signals, sample_liveness, variant_landings, draft_items, page_draft_items, reach_gate, index_gate, sitemap_found, sitemap_score, canonical_landing, declared_values,
    keyword_overlap, shared_term, repeated_heads,
]


#: Queries on a few inline rows, one for each branch of an operator: tests run them, the driver's list has those on tables.
INLINE = """
source_tier meta_items robots_decision redirect_chain noindex_signals variant_landings draft_items index_gate
sitemap_found canonical_landing robots_observation robots_groups robots_rule_lines blocked_classes robots_sitemap_lines robots_noindex_lines
blocked_by_server index_gate_of_robots sitemap_discovery sitemap_found_in_crawl sitemap_parse sitemap_limits lastmod_dates joined_links
inline_audit_items jsonld_types jsonld_values jsonld_consistency page_images external_domains winner_pages noindex_of_answers
decoded_answers entry_points evidence_scorecard inline_topics topic_pages inline_bench fix_lookup next_fix
fix_first check_commands meta_branches meta_scorecard draft_block_extract draft_branches draft_scorecard rubric_lines
html_reports run_changes
""".split()


def _all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [*_QUERIES, *site_queries._QUERIES, *derived_queries._QUERIES, *derived_lanes._QUERIES]}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries that read the given tables."""
    return {name: f for name, f in _all().items() if name not in INLINE}


def inline_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _all()[name] for name in INLINE}


def _sql() -> dict[str, str]:
    from .derived_lanes_oracles import LANE_ORACLES
    from .derived_oracles import DERIVED_ORACLES
    from .oracles import ORACLES
    from .site_oracles import SITE_ORACLES

    return ORACLES | SITE_ORACLES | DERIVED_ORACLES | LANE_ORACLES


def oracle_sql() -> dict[str, str]:
    known = _sql()
    return {name: known[name] for name in queries() if name in known}


def inline_sql() -> dict[str, str]:
    return {name: _sql()[name] for name in INLINE}
