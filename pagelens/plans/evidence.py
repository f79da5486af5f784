"""Scores of the audit in long form, each with the words, blocks or places that decided it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .site_items import shared_terms

#: Items with evidence, and how many pieces of it are shown.
SHOWN = {"C2": 6, "C3": 3, "C4": 5, "K2": 5}
PIECE = 110


def _steps(x: Column, *cuts: float) -> Column:
    return F.when(x >= cuts[0], 3).when(x >= cuts[1], 2).when(x > cuts[2], 1).otherwise(0)


def _first_hits() -> Column:
    """Terms of title and description among the first words."""
    first = F.array_join(F.slice("words", 1, 50), " ")
    return F.array_sort(F.array_intersect(T.terms(F.concat_ws(" ", F.col("title"), F.col("description"))), T.terms(first)))


def _phrases_held() -> Column:
    """Marketing phrases, each as often as it stands there."""
    return F.flatten(F.transform("blocks", lambda b: F.regexp_extract_all(b["text"], F.lit(T.MARKETING_SCAN), F.lit(0))))


def _same_word() -> Column:
    """Terms that stand in most of title, h1, address and first sentence, with the number of places."""
    return shared_terms(F.col("title"), F.array_join("h1", " "), F.regexp_replace(U.path(F.col("url")), "[-_/]+", " "), F.get(T.sentences(F.col("body")), F.lit(0)))


def _items() -> list[Column]:
    """Each item from what was found on a page."""
    hits, held, phrases, all_, most = F.size("hit"), F.size("held"), F.size("phrases"), F.col("n_blocks"), F.col("same.most")
    nav = F.col("in_nav") / F.greatest(F.lit(1), F.col("n_first"))
    share = F.coalesce(held / F.nullif(all_, F.lit(0)), F.lit(0.0))
    none = F.array().cast("array<string>")
    return [
        _item("C2", F.when(hits >= 2, F.when(nav < 0.3, 3).when(nav <= 0.6, 2).otherwise(1)).when(hits == 1, 1).otherwise(0), hits, F.col("in_nav"), F.col("hit")),
        _item("C3", _steps(share, 0.3, 0.15, 0), held, all_, F.col("held")),
        _item("C4", F.when(phrases == 0, 3).when(phrases == 1, 2).when(phrases <= 3, 1).otherwise(0), phrases, all_, F.col("phrases")),
        _item("K2", F.when(most >= 4, 3).when(most == 3, 2).when(most == 2, 1).otherwise(0), most, F.lit(4), F.when(most > 1, F.col("same.terms")).otherwise(none)),
    ]


def _item(item: str, score: Column, n: Column, of: Column, evidence: Column) -> Column:
    return F.struct(F.lit(item).alias("item"), score.alias("score"), n.cast("int").alias("n"), of.cast("int").alias("of"), F.slice(evidence, 1, SHOWN[item]).alias("evidence"))


def item_evidence(page: DataFrame) -> DataFrame:
    """(page_id, item, machine_locked, observed, score, n, of, evidence, reason) of ``page_audit.facts``, in one pass.

    n of ``of`` is what was counted: terms and words from the navigation (C2), blocks (C3), phrases and blocks (C4), places
    (K2).  Of a page that was not observed the score, counts and evidence are NULL and the reason says so.
    """
    first = F.slice("words", 1, 50)
    # Found once each, as columns: what an item's score, counts and evidence are told from.
    found = page.select(
        "page_id", F.col("body").isNotNull().alias("observed"), _first_hits().alias("hit"), F.size(F.filter(first, lambda w: F.array_contains(F.col("nav"), F.lower(w)))).alias("in_nav"), F.size(first).alias("n_first"),
        F.transform(F.filter("blocks", T.is_fact), lambda b: F.substring(b["text"], 1, PIECE)).alias("held"), F.size("blocks").alias("n_blocks"), _phrases_held().alias("phrases"), _same_word().alias("same"),
    )
    rows = found.select("page_id", "observed", F.explode(F.array(*_items())).alias("i"))
    of = lambda c: F.when(F.col("observed"), F.col(f"i.{c}")).alias(c)
    return rows.select("page_id", "i.item", F.lit(True).alias("machine_locked"), "observed", of("score"), of("n"), of("of"), of("evidence"), F.when(~F.col("observed"), "page not observed").alias("reason"))
