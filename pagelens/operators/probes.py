"""Signals and scores from headers and probes; NULL is unobserved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.tables import reach


def noindex_signals(pages: DataFrame) -> DataFrame:
    """(id, place) for each place of (id, meta_robots, header) that keeps a page out of indexes."""
    says = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("noindex")
    places = F.array_compact(F.array(F.when(says(F.col("meta_robots")), F.lit("meta")), F.when(says(F.col("header")), F.lit("header"))))
    return pages.select("id", F.explode(places).alias("place"))


def sample_liveness(sample: DataFrame) -> DataFrame:
    """Counts and T3 of each site from (site, status, redirected): a blocked page says nothing against the site."""
    state = reach(F.col("status"))
    counts = sample.groupBy("site").agg(F.count_if(state == "dead").alias("dead"), F.count_if(state == "blocked").alias("blocked"), F.count_if((state == "ok") & F.col("redirected")).alias("redirected"))
    score = F.when(F.col("dead") >= 2, 0).when(F.col("dead") == 1, 1).when(F.col("redirected") > 0, 2).otherwise(3)
    return counts.withColumn("T3", score)


def entry_points(sites: DataFrame, crawl: DataFrame) -> DataFrame:
    """(site, variant, final) of (site) and (url, final, status): with and without www, by both schemes; NULL where none answered."""
    bare = U.bare_host(F.col("site"))
    variants = F.array(*(F.concat(F.lit(f"{scheme}://{prefix}"), bare) for scheme in ("http", "https") for prefix in ("", "www.")))
    tried = sites.select("site", F.explode(variants).alias("variant"))
    answers = crawl.select(F.col("url").alias("variant"), F.when(reach(F.col("status")) == "ok", F.col("final")).alias("final"))
    return tried.join(answers, "variant", "left").select("site", "variant", "final")


def variant_landings(variants: DataFrame) -> DataFrame:
    """T6 of each site from (site, variant, final): on how many addresses its entry points land."""
    counts = variants.groupBy("site").agg(F.count("final").alias("seen"), F.count_if(F.col("final").isNull()).alias("missing"), F.count_distinct(U.norm_url(F.col("final"))).alias("places"))
    score = F.when(F.col("seen") < 2, None).when((F.col("places") == 1) & (F.col("missing") == 0), 3).when(F.col("places") == 1, 2).when(F.col("places") == 2, 1).otherwise(0)
    return counts.select("site", "seen", "missing", "places", score.alias("T6"))
