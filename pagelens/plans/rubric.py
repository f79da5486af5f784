"""The rubric as a dimension table, lane totals and the one next action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Audit items with weight (gates have none) and the order in which a failing item is acted on.
AUDIT_WEIGHTS = {
    "G1": None, "G2": None, "G3": None,
    "T1": 3, "T3": 3, "T4": 3, "T5": 3, "T7": 3, "C2": 3, "C3": 3,
    "T2": 2, "T6": 2, "T8": 2, "T9": 2, "C1": 2, "C4": 2, "K1": 2, "K2": 2, "I1": 2,
    "I2": 1, "I3": 1,
}
ACTION_ORDER = "G1 G2 G3 T1 T5 T4 T7 T3 T2 T6 T8 T9 C1 C2 K2 C3 C4 K1 I1 I2 I3 W6".split()
PASS_AT = 2
#: Our own: the weights of the two other lanes are not published, but for that of C4.
WRITE_WEIGHTS = {"WG1": None, "D1": None, "D2": None, **dict.fromkeys(("C4", "W1", "W2", "W3", "W4", "W5", "W6", "W7", "W8", "W9"), 2)}
META_WEIGHTS = {"MG1": None, **dict.fromkeys(("M1", "M2", "M3", "M4", "M5", "M6", "M7", "C4"), 2)}


def rubric(spark: SparkSession, weights: dict[str, int | None] = AUDIT_WEIGHTS) -> DataFrame:
    rank = {item: i for i, item in enumerate(ACTION_ORDER)}
    rows = [(i, "gate" if w is None else "score", w, 1 if w is None else PASS_AT, rank.get(i, 99)) for i, w in weights.items()]
    return spark.createDataFrame(rows, "item string, kind string, weight int, pass_at int, action_rank int")


def long_scores(wide: DataFrame, entity: str, items: list[str]) -> DataFrame:
    """(entity, item, score) of a row with a column for each item; NULL is unobserved and stays NULL."""
    return wide.select(F.col(entity).alias("entity"), *(F.col(i).cast("int").alias(i) for i in items)).unpivot("entity", items, "item", "score")


def scorecard(scores: DataFrame, items: DataFrame) -> DataFrame:
    """Totals and verdict of each entity: an unobserved item is in neither the points nor their maximum."""
    s = scores.join(F.broadcast(items), "item")  # a row for each criterion
    seen, ok = F.col("score").isNotNull(), F.col("score") >= F.col("pass_at")
    point = seen & (F.col("kind") == "score")
    names = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("item")))), ",")
    out = s.groupBy("entity").agg(
        F.coalesce(F.sum(F.when(point, F.col("score") * F.col("weight"))), F.lit(0)).alias("got"),
        F.coalesce(F.sum(F.when(point, 3 * F.col("weight"))), F.lit(0)).alias("full"),
        names(seen & ~ok & (F.col("kind") == "gate")).alias("failed_gates"),
        names(seen & ~ok & (F.col("kind") == "score")).alias("below_floor"),
        names(~seen).alias("unobserved"),
    )
    verdict = F.when(F.col("failed_gates") != "", "REJECT").when(F.col("below_floor") != "", "REWORK").otherwise("PASS")
    return out.withColumns({"ratio": F.col("got") / F.nullif("full", F.lit(0)), "verdict": verdict})


def next_action(scores: DataFrame, items: DataFrame) -> DataFrame:
    """The first failing item of each entity, in the fixed order; entities without one have none."""
    failing = scores.join(F.broadcast(items), "item").where("score < pass_at")
    return failing.groupBy("entity").agg(F.min_by("item", "action_rank").alias("item"))


def exit_code(verdict: Column, lane: str) -> Column:
    """What a command that judges one entity ends with: 0 for PASS; the audit has 1 for all else, the other lanes 2 for REJECT."""
    return F.when(verdict == "PASS", 0).when((verdict == "REJECT") & F.lit(lane != "audit"), 2).otherwise(1)
