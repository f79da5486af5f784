"""Relational operators of site audits, over rows of any number of sites at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import ranked, settled


def systematic_sample(rows: DataFrame, site: str, position: str, k: int) -> DataFrame:
    """Every step-th row of a site from its first, k at most, step being its rows over k; never random.

    Rows are numbered in one order of all sites, so that a site with many of them is no single task.
    """
    numbered = ranked(rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(site).alias("site"), F.col(position).alias("position")), "site", "position", name="at")
    sizes = numbered.groupBy("site").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    step, nth = F.greatest(F.lit(1), F.expr(f"n div {k}")), F.col("at") - F.col("begin")
    return numbered.join(sizes, "site").where((nth % step == 0) & (nth / step < k)).select("row.*")


def term_coverage(terms: DataFrame, least: int = 2) -> DataFrame:
    """(site, term, n_pages) from (site, page_id, term): terms that at least ``least`` pages of a site have."""
    return terms.groupBy("site", "term").agg(F.count_distinct("page_id").alias("n_pages")).where(F.col("n_pages") >= least)


def topic_gaps(coverage: DataFrame, mine: str, noise: DataFrame, top: int | None = 20) -> DataFrame:
    """Terms that other sites cover and ``mine`` lacks, each from the first site that has it; the feature is a top list."""
    own = coverage.where(F.col("site") == mine).select("term")
    others = coverage.where(F.col("site") != mine).join(own, "term", "left_anti").join(noise, "term", "left_anti")
    first = others.groupBy("term").agg(F.min_by("n_pages", "site").alias("rival_pages"), F.min("site").alias("rival"))
    return first.orderBy(F.desc("rival_pages"), "term").limit(top) if top else first


def similar_pairs(terms: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(site, a, b, jaccard) of pages of a site whose term sets are similar, by the rarest of their terms.

    Of two sets of n and m terms that are this similar, one of the first n - ceil(threshold * n) + 1 terms of the one
    is among those of the other, in any order that both share; with rare terms first few pages meet on one.
    """
    # Terms come from pages' HTML, which is to be read once.
    terms = settled(terms.select("site", "page_id", "term").distinct())
    common = terms.groupBy("site", "term").agg(F.count(F.lit(1)).alias("pages"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pages", "term"))), lambda x: x["term"])
    sets = settled(terms.join(common, ["site", "term"]).groupBy("site", "page_id").agg(ordered.alias("terms")))
    n = F.size("terms")
    prefix = F.slice("terms", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)
    posted = sets.select("site", "page_id", n.alias("n"), F.explode(prefix).alias("term"))
    a = posted.select("site", "term", F.col("page_id").alias("a"), F.col("n").alias("na"))
    b = posted.select("site", "term", F.col("page_id").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, ["site", "term"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("site", "a", "b").distinct()
    met = met.join(sets.select(F.col("page_id").alias("a"), F.col("terms").alias("x")), "a").join(sets.select(F.col("page_id").alias("b"), F.col("terms").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.withColumn("jaccard", both / (F.size("x") + F.size("y") - both)).where(F.col("jaccard") >= threshold).select("site", "a", "b", "jaccard")


def similar_classes(terms: DataFrame, threshold: float = 0.6, enough: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages of a site with equal term sets as one class, and classes that are similar, of (site, page_id, term).

    (site, class, n_pages): class is the least page_id.  (site, page_id, class): which pages belong to it.
    (site, a, b, pages_a, pages_b, jaccard): similar classes, each pair once.  Pairs inside of a class are known by its
    number of pages alone and are never made; of the rest see ``similar_pairs``, whose prefixes are those of classes here.
    With ``enough``, sites whose pages have that many pairs inside of classes have no similar classes looked for: a score
    that does not tell more pairs apart is settled by then.
    """
    terms = settled(terms.select("site", "page_id", "term").distinct())
    sets = terms.groupBy("site", "page_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))  # a page's own few terms
    sets = settled(sets.withColumn("key", F.xxhash64("terms")))
    classes = settled(sets.groupBy("site", "key", "terms").agg(F.min("page_id").alias("class"), F.count(F.lit(1)).alias("n_pages")))
    members = sets.join(classes.select("site", "key", F.col("terms").alias("_terms"), "class"), ["site", "key"]).where(F.col("terms") == F.col("_terms")).select("site", "page_id", "class")

    open_ = classes
    if enough is not None:
        pairs = F.sum(F.col("n_pages") * (F.col("n_pages") - 1) / 2)
        open_ = classes.join(settled(classes.groupBy("site").agg(pairs.alias("pairs")).where(F.col("pairs") >= enough).select("site")), "site", "left_anti")
    posted = open_.select("site", "class", F.explode("terms").alias("term"))
    common = settled(posted.groupBy("site", "term").agg(F.count(F.lit(1)).alias("classes")))
    ordered = posted.join(common, ["site", "term"]).groupBy("site", "class").agg(F.transform(F.array_sort(F.collect_list(F.struct("classes", "term"))), lambda x: x["term"]).alias("order"))
    n = F.size("order")
    prefix = F.slice("order", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)
    first = settled(ordered.select("site", "class", n.alias("n"), F.explode(prefix).alias("term")))
    a, b = (first.select("site", "term", F.col("class").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    met = a.join(b, ["site", "term"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("site", "a", "b").distinct()
    side = lambda x: classes.select("site", F.col("class").alias(x), F.col("terms").alias(f"terms_{x}"), F.col("n_pages").alias(f"pages_{x}"))
    met = met.join(side("a"), ["site", "a"]).join(side("b"), ["site", "b"])
    both = F.size(F.array_intersect("terms_a", "terms_b"))
    met = met.withColumn("jaccard", both / (F.size("terms_a") + F.size("terms_b") - both)).where(F.col("jaccard") >= threshold)
    return classes.select("site", "class", "n_pages"), members, met.select("site", "a", "b", "pages_a", "pages_b", "jaccard")


def alike_pages(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(site, pairs): how many pairs of alike pages a site has, from ``similar_classes``, without one of them."""
    inside = classes.select("site", (F.col("n_pages") * (F.col("n_pages") - 1) / 2).cast("long").alias("n"))
    across = links.select("site", (F.col("pages_a") * F.col("pages_b")).alias("n"))
    return inside.unionByName(across).groupBy("site").agg(F.sum("n").alias("pairs")).where("pairs > 0")


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items whose score changed between two runs of (entity, item, score), NULL being unobserved."""
    both = new.withColumnRenamed("score", "new").join(old.withColumnRenamed("score", "old"), ["entity", "item"])
    change = F.when(F.col("old").isNull() & F.col("new").isNull(), "still_unobserved").when(F.col("old").isNull() | F.col("new").isNull(), "observability_changed").when(F.col("new") > F.col("old"), "fixed").when(F.col("new") < F.col("old"), "worse")
    return both.withColumn("change", change).where("change is not null")
