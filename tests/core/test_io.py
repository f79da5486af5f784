"""Files in and out, what is unobserved, and pages that are alike, against plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from pagelens.operators.ordering import drop_settled, ranked, settled
from pagelens.operators.relational import compare_runs, similar_pairs, systematic_sample
from pagelens.plans import draft_lane, page_audit, rubric
from pagelens.sinks import reports
from pagelens.sources import tables


def test_results_there_and_back(spark, tmp_path):
    rows = [("p", "C1", 3), ("p", "C2", None), ("q é", "C1", 0)]
    reports.write_json(spark.createDataFrame(rows, "entity string, item string, score int"), str(tmp_path / "run"))
    again = tables.results(spark, str(tmp_path / "run"), "entity string, item string, score int")
    assert sorted(map(tuple, again.collect())) == rows
    assert {r.change for r in compare_runs(again, again).collect()} == {"still_unobserved"}


def test_drafts_of_a_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("x\n```html\n<p>3 GB</p>\n```\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("no block", encoding="utf-8")
    read = tables.drafts(spark, str(tmp_path)).select("id", draft_lane.content_block(F.col("draft")).alias("b"))
    assert sorted(map(tuple, read.collect())) == [("a.md", "<p>3 GB</p>\n"), ("b.md", None)]


def test_unobserved_page_has_no_points(spark):
    pages = spark.createDataFrame([(1, "https://a.com/", None), (2, "https://a.com/x", "")], "page_id int, url string, html string")
    scores = rubric.long_scores(page_audit.audit_items(page_audit.facts(pages)), "page_id", page_audit.ITEMS)
    assert scores.where("score is not null").count() == 0
    cards = rubric.scorecard(scores, rubric.rubric(spark)).collect()
    assert {(r.got, r.full, r.ratio, r.verdict) for r in cards} == {(0, 0, None, "PASS")} and all(r.unobserved.count(",") == len(page_audit.ITEMS) - 1 for r in cards)


def test_similar_pairs(spark):
    rng = random.Random(6)
    pages = {(f"s{k % 3}", k): {f"t{rng.randint(0, 14)}" for _ in range(rng.randint(1, 9))} for k in range(120)}
    rows = [(s, k, t) for (s, k), own in pages.items() for t in own]
    got = {(r.site, r.a, r.b): r.jaccard for r in similar_pairs(spark.createDataFrame(rows + rows[:50], "site string, page_id int, term string")).collect()}
    want = {(s, a, b): len(x & y) / len(x | y) for ((s, a), x), ((t, b), y) in itertools.product(pages.items(), repeat=2) if s == t and a < b and len(x & y) >= 0.6 * len(x | y)}
    assert got == want and want


def test_sample_and_ranks(spark):
    rows = [(f"s{k % 4}", k * 7 % 101, k) for k in range(101)] + [("one", 5, 1)]
    df = spark.createDataFrame(rows, "site string, at int, rank int")
    want = []
    for site in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == site), key=lambda r: r[1])
        want += own[:: max(1, len(own) // 5)][:5]
    assert sorted(map(tuple, systematic_sample(df, "site", "at", 5).collect())) == sorted(want)
    placed = ranked(df.select("at", "site"), F.desc("at"), "site", name="place").collect()
    assert [(r.at, r.site) for r in sorted(placed, key=lambda r: r.place)] == sorted(((r[1], r[0]) for r in rows), key=lambda r: (-r[0], r[1]))


def test_settled_tables_can_be_dropped(spark):
    table = settled(spark.range(5))
    assert table.count() == 5
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    drop_settled(spark)
    import os

    assert not os.path.exists(folder)
