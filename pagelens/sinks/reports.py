"""Results for people: JSON files, the rubric as a Markdown table, and a page of HTML for each scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def write_json(results: DataFrame, path: str) -> None:
    """A JSON object a line, without fields that are NULL."""
    results.write.mode("errorifexists").json(path)


def rubric_lines(rubric: DataFrame) -> DataFrame:
    """(nth, line): the rubric as rows of a Markdown table, heading first."""
    spark = rubric.sparkSession
    head = spark.createDataFrame([(-2, "| item | kind | weight | passes at |"), (-1, "|-|-|-|-|")], "nth int, line string")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "item", "kind", F.coalesce(F.col("weight").cast("string"), F.lit("-")), F.col("pass_at").cast("string")), F.lit(" |"))
    return head.unionByName(rubric.select(F.col("action_rank").alias("nth"), row.alias("line")))


def html_reports(cards: DataFrame) -> DataFrame:
    """(entity, html) of scorecards (entity, got, full, verdict, failed_gates, below_floor, unobserved)."""
    line = lambda name, c: F.concat(F.lit(f"<tr><th>{name}</th><td>"), T.escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td></tr>"))
    rows = F.concat(line("verdict", "verdict"), line("points", "got"), line("of", "full"), line("failed gates", "failed_gates"), line("below floor", "below_floor"), line("not observed", "unobserved"))
    name = T.escaped(F.col("entity").cast("string"))
    return cards.select("entity", F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), name, F.lit("</title><h1>"), name, F.lit("</h1><table>"), rows, F.lit("</table>")).alias("html"))
