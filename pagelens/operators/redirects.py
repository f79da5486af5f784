"""Redirect chains of many addresses at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .ordering import settled

HOPS = 4


def one_answer(answers: DataFrame) -> DataFrame:
    """(url, status, next) of (url, status, location), one row for each url, the least status and location if there are several.

    next is the address that a 3xx answer with a location leads to, relative ones resolved against the url; a location
    of any other answer leads nowhere.
    """
    first = answers.groupBy("url").agg(F.min(F.struct(F.col("status").isNull().alias("none"), "status", F.coalesce("location", F.lit("")).alias("location"))).alias("a"))
    moved = F.col("a.status").between(300, 399) & (F.col("a.location") != "")
    return first.select("url", F.col("a.status").alias("status"), F.when(moved, U.joined(F.col("url"), F.col("a.location"))).alias("next"))


def follow_redirects(starts: DataFrame, answers: DataFrame, limit: int = HOPS) -> DataFrame:
    """(start, url, status, hops): where each different start ends by (url, status, location).

    Each step looks up only the chains that still move.  A chain that would take more than ``limit`` hops, as every loop
    does, ends unobserved: its status is NULL and its hops are limit + 1; so is an address without an answer.
    """
    answers = settled(one_answer(answers))
    moving = starts.select("start", F.col("start").alias("url"), F.lit(0).alias("hops")).distinct()
    ended = None
    for left in range(limit, -1, -1):
        at = settled(moving.join(answers, "url", "left"))
        done = at.where("next is null").select("start", "url", "status", "hops")
        ended = done if ended is None else ended.unionByName(done)
        moving = at.where("next is not null").select("start", F.col("next").alias("url"), (F.col("hops") + 1).alias("hops"))
        if left and moving.isEmpty():
            return ended
    return ended.unionByName(moving.select("start", "url", F.lit(None).cast("int").alias("status"), "hops"))
