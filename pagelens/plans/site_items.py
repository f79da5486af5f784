"""Items of the audit lane that need more than one page: reach, crawl rules, sitemaps, redirects and peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonld as J
from ..functions import text as T
from ..operators.ordering import settled
from ..sources.tables import reach

# JSON-LD fields that the body should show, and the entries that a sitemap may hold.
WATCHED = ("price", "ratingValue", "reviewCount", "ratingCount")
MAX_ENTRIES = 50_000


def reach_gate(probes: DataFrame) -> DataFrame:
    """G1 of (id, status)."""
    state = reach(F.col("status"))
    return probes.select("id", F.when(state != "unknown", (state == "ok").cast("int")).alias("G1"))


def index_gate(robots: DataFrame, signals: DataFrame) -> DataFrame:
    """G2 of each site of (site, class, allowed): open to searchers and without noindex; training agents do not count."""
    rules = robots.groupBy("site").agg(F.bool_and(F.col("allowed") | (F.col("class") == "training")).alias("open"))
    shut = signals.select("site", F.lit(True).alias("shut")).distinct()
    return rules.join(shut, "site", "left").select("site", (F.col("open") & F.col("shut").isNull()).cast("int").alias("G2"))


def sitemap_found(tried: DataFrame) -> DataFrame:
    """T1 of each site of (site, status, usable, declared), a row for each address that was tried."""
    state = reach(F.col("status"))
    seen = tried.groupBy("site").agg(F.bool_or("usable").alias("usable"), F.bool_or("declared").alias("declared"), F.bool_or((state == "ok") & ~F.col("usable")).alias("unusable"), F.bool_and(state == "dead").alias("dead"))
    return seen.select("site", F.when(F.col("usable") & F.col("declared"), 3).when(F.col("usable"), 2).when(F.col("unusable"), 1).when(F.col("dead"), 0).alias("T1"))


def sitemap_score(hygiene: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """T2 from the counts of issues, and those of (site, issue): the worst class of issue decides."""
    bad = (F.col("relative") + F.col("cross_host") + F.col("fragment") > 0) | F.col("mixed_scheme")
    over = F.col("n") > MAX_ENTRIES
    if limits is not None:
        large = limits.where(F.col("issue").isin("too_many", "size")).select("site", F.lit(True).alias("large")).distinct()
        hygiene, over = hygiene.join(large, "site", "left"), over | F.coalesce("large", F.lit(False))
    return hygiene.select("site", F.when(over, 0).when(bad, 1).when((F.col("lastmod_format") > 0) | F.col("lastmod_uniform"), 2).otherwise(3).alias("T2"))


def canonical_landing(landings: DataFrame) -> DataFrame:
    """T5 of (start, status, hops): where a canonical address lands."""
    status = F.col("status")
    return landings.select("start", F.when(status.isNull(), None).when(status == 200, 3).when((status == 404) | (status >= 500), 0).when(F.col("hops") <= 1, 2).otherwise(1).alias("T5"))


def declared_score(body: Column, pairs: Column) -> Column:
    """T9 of a text and the values that its JSON-LD declares."""
    watched = F.filter(pairs, lambda p: p["key"].isin(*WATCHED))
    miss = F.size(F.filter(watched, lambda p: ~F.contains(body, p["value"])))
    return F.when(F.size(watched) <= 0, None).when(miss == 0, 3).when(miss == 1, 2).when(miss == 2, 1).when(miss > 2, 0)


def declared_values(pages: DataFrame) -> DataFrame:
    """page_id and T9: whether values that JSON-LD declares stand in the text."""
    html = F.col("html")
    told = pages.select("page_id", T.clean_text(html).alias("body"), J.page_facts(html)["pairs"].alias("pairs"))
    return told.select("page_id", declared_score(F.col("body"), F.col("pairs")).alias("T9"))


def keyword_overlap(pairs: DataFrame, peers: DataFrame) -> DataFrame:
    """K1 of each site from its number of pairs of alike pages (site, pairs) and its pages (site): few pages leave it unobserved."""
    seen = peers.groupBy("site").agg(F.count(F.lit(1)).alias("peers")).join(pairs, "site", "left")
    n = F.coalesce("pairs", F.lit(0))
    return seen.select("site", F.when(F.col("peers") < 3, None).when(n == 0, 3).when(n == 1, 2).when(n <= 3, 1).otherwise(0).alias("K1"))


def shared_terms(*places: Column) -> Column:
    """struct<most, terms>: in how many of the places one term stands, and the terms that stand in that many, in order.

    A place has each of its terms once, so in the sorted list of all of them a term stands as often as places have it.
    """
    found = F.sort_array(F.flatten(F.array(*(T.terms(F.coalesce(c, F.lit(""))) for c in places))))

    def told(s: Column) -> Column:
        times = lambda n: F.filter(s, lambda t, i: t == F.get(s, i + n - 1))
        most = F.lit(0)
        for n in range(1, len(places) + 1):
            most = F.when(F.size(times(F.lit(n))) > 0, n).otherwise(most)
        return T.bound(most, lambda m: F.struct(m.alias("most"), F.when(m > 0, times(m)).otherwise(s).alias("terms")))

    return T.bound(found, told)


def shared_score(*places: Column) -> Column:
    """K2 of the four places where a keyword may stand: in how many of them one term does."""
    return T.bound(shared_terms(*places)["most"], lambda most: F.when(most >= 4, 3).when(most == 3, 2).when(most == 2, 1).otherwise(0))


def shared_term(page: DataFrame) -> DataFrame:
    """page_id and K2 of (page_id, title, h1, path, first)."""
    return page.select("page_id", shared_score(*(F.col(c) for c in ("title", "h1", "path", "first"))).alias("K2"))


def repeated_heads(page: DataFrame) -> DataFrame:
    """page_id and M7 of (page_id, site, title, description) against the other pages of the site."""
    page = settled(page)
    titles = page.where("title <> ''").groupBy("site", "title").agg((F.count(F.lit(1)) - 1).alias("same_title"))
    texts = page.where("description <> ''").groupBy("site", "description").agg((F.count(F.lit(1)) - 1).alias("same_text"))
    peers = page.groupBy("site").agg(F.count(F.lit(1)).alias("peers"))
    # Settled, the counts are plain tables, and Spark splits what a site or title with very many pages brings to a join.
    full = page.join(settled(peers), "site").join(settled(titles), ["site", "title"], "left").join(settled(texts), ["site", "description"], "left")
    return full.select("page_id", F.when(F.col("peers") < 2, None).when(F.col("same_title") >= 2, 0).when(F.col("same_title") == 1, 1).when(F.col("same_text") > 0, 2).otherwise(3).alias("M7"))
