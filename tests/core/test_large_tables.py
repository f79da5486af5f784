"""What larger tables and longer pages showed: steps that grew faster than their input, and rows that the small tables lack."""

import itertools
import time
import tracemalloc

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.operators.relational import similar_classes
from pagelens.plans import evidence, page_audit
from pagelens.queries import oracle_sql, queries
from pagelens.sources import responses, tables


def _words(n):
    return [a + b + c for a, b, c in itertools.islice(itertools.product("abcdefghijk", repeat=3), n)]


def test_same_word_of_a_long_page_in_one_pass(spark):
    """K2 was worked out again for each pair of terms: minutes for a page like this one."""
    words = _words(400)
    html = f"<title>{' '.join(words)}</title><h1>{' '.join(words[:300])}</h1><p>{' '.join(words[200:])}.</p>"
    began = time.time()
    rows = {r.item: r for r in evidence.item_evidence(page_audit.facts(spark.createDataFrame([(1, f"http://a.org/{words[250]}", html), (2, "http://a.org/x", "<p></p>")], "page_id long, url string, html string"))).where("page_id = 1").collect()}
    assert (rows["K2"].n, rows["K2"].score, rows["K2"].evidence) == (4, 3, [words[250]])
    assert time.time() - began < 40


def test_sentences_keep_their_digits(spark):
    """The place of a sentence was taken for the characters to trim, and its digits went from the sentence's ends."""
    text = "Nothing is before this sentence. 1 is what this one begins with. And this one ends with the number 2.\u3000 \u00a0\u2009Spaces of all kinds go.\u00a0"
    got = spark.createDataFrame([(text.replace("2.", "2! Four words of five. 4 1 2 3 0"),), (text,)], "t string").select(T.sentences(F.col("t")).alias("s")).collect()
    assert got[1].s == ["Nothing is before this sentence.", "1 is what this one begins with.", "And this one ends with the number 2.\u3000 \u00a0\u2009Spaces of all kinds go."]
    assert got[0].s[1:3] == ["1 is what this one begins with.", "And this one ends with the number 2!"] and got[0].s[-1].startswith("4 1 2 3 0")


def _equal(spark, name, rows, folder):
    """A query over pages (page_id, url, html) equals its SQL."""
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    got, want = queries()[name](spark, str(folder)), con.sql(oracle_sql()[name])
    pick = lambda names: sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda names, found: sorted(repr([r[i] for i in pick(names)]) for r in found)
    assert shown(got.columns, [tuple(r) for r in got.collect()]) == shown(want.columns, want.fetchall())


def test_peers_of_one_address(spark, tmp_path):
    """Pages of one address, of which some are listed, some are not and one was not observed."""
    heads = ["red apple pie", "red apple pie", "green tea cup", "blue sky", "red apple pie now"]
    rows = [(k, f"http://a.org/{[0, 1, 1, 1, 4, 5, 6, 6, 8, 9, 0, 11, 11, 13, 14, 9][k]}", f"<title>{heads[k % 5]}</title><h1>{heads[k % 3]}</h1>") for k in range(16)]
    rows += [(k, f"http://b.org/{k % 3}", f"<title>{heads[k % 5]}</title>") for k in range(20, 45)] + [(k, "http://c.org/", "<title>one</title>") for k in (50, 51, 55)]
    _equal(spark, "page_peer_items", rows, tmp_path)


def test_answers_are_unpacked_a_few_at_a_time():
    """Of a batch of long answers only a few are Python objects at once."""
    n, body = 4000, b"\xc3\xa9" * 10_000
    columns = (pa.array([body, None] * (n // 2), pa.binary()), pa.nulls(n, pa.string()), pa.array(["text/html; charset=utf-8"] * n))
    tracemalloc.start()
    try:
        told = responses._decoded.func(*columns)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert told[0].as_py() == "é" * 10_000 and told[1].as_py() is None and len(told) == n
    assert peak < 16 << 20


def test_large_files_of_pages_are_dealt_to_more_tasks_than_cores(spark, tmp_path, monkeypatch):
    rows = [(k, f"http://a.org/{k}", str(hash(f"{k}")) * 40) for k in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(tables, "SHARE", 1 << 10)
    found = tables.pages(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert sorted(tuple(r) for r in found.collect()) == rows


def test_sites_with_enough_pairs_are_not_compared(spark):
    """Four pairs settle K1: only a site with fewer inside of its classes has similar classes looked for."""
    titles = {"a": ["red apple pie"] * 4 + ["red apple tart pie"] * 2, "b": ["red apple pie"] * 2 + ["red apple tart pie", "blue sky"], "c": ["one two three", "four five six", "seven eight nine"]}
    pages = [(s, f"{s}{k}", t.split()) for s, ts in titles.items() for k, t in enumerate(ts)]
    scored = spark.createDataFrame(pages, "site string, page_id string, terms array<string>")
    terms = scored.select("site", "page_id", F.explode("terms").alias("term"))
    assert {r.site for r in similar_classes(terms)[2].collect()} == {"a", "b"} and {r.site for r in similar_classes(terms, enough=4)[2].collect()} == {"b"}
    assert {tuple(r) for r in page_audit.site_overlap(scored).collect()} == {("a", 0), ("b", 1), ("c", 3)}
