"""Benchmark decontamination as a prefix-filtered set join of shingles, in DataFrame functions alone.

Words are lower-cased runs of letters, digits and characters beyond ASCII.  An item's windows are its runs of
``width`` words, or the whole item if it is shorter.  A window's tokens are its shingles of ``GRAM`` words, or all of
it if it is shorter.

1. One pass over the documents finds where the benchmark's shingles stand: hashes of all of a document's shingles are
   joined with the benchmark's, and only what meets goes on.
2. Counts of what was found order the shingles by rarity.  A document that holds a window holds all of its shingles,
   so the necessary prefix of a window under full containment is a single token, its rarest; a window with a shingle
   that no document has cannot occur.  Documents meet windows on that token alone.
3. The shingle's place in the window and the number of the document's words bound where the window could lie.
4. What is left is verified over the whole window: each of its shingles has to be found at its place.

Texts are read and never shuffled; only places of shingles that the benchmark has are.  Hashes of 64 bits stand for
words and shingles; a window of ten words is six of them.

Cases: a null text has no words; an item without words has no window; rows repeat as they are; a null doc_id is kept;
empty tables give no hits; other columns are ignored, and ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import settled
from .columns import bitmap, keyed, left_join_few, maybe_in, plain_words

WIDTH, GRAM = 10, 5
#: What plain_words finds, in a text that is not lower-cased.
ONE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, words): the distinct windows of each item."""
    items = benchmark.select("item_id", plain_words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words")).distinct()


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(hashes: Column, gram: int) -> Column:
    """A hash of each run of ``gram`` words, in order, from the hashes of the words; none if they are fewer."""
    each = F.transform(F.sequence(F.lit(0), F.size(hashes) - gram), lambda i: F.xxhash64(F.lit(gram), *(F.get(hashes, i + j) for j in range(gram))))
    return F.when(F.size(hashes) >= gram, each).otherwise(F.array().cast("array<long>"))


def _places(docs: DataFrame, vocabulary: DataFrame, grams: list[int]) -> DataFrame:
    """(_id, _k, n_words, pos, token): where documents have the vocabulary's shingles, from one pass over the texts."""
    worded = docs.where("text is not null").select("_id", "_k", _hashed(plain_words(F.col("text"))).alias("h"))
    worded = worded.select("_id", "_k", F.size("h").alias("n_words"), F.concat(*(_shingles(F.col("h"), g) for g in grams)).alias("tokens"))
    # An outer explode, as no filter is then moved below the columns made here, where they would be made anew.
    met = worded.select("_id", "_k", "n_words", F.posexplode_outer("tokens").alias("nth", "token"))
    # Of all shingles few pass the bitmap of the vocabulary, and these alone are joined with it.
    met = maybe_in(met, F.col("token"), bitmap(F.col("token"), vocabulary)).join(vocabulary, "token")
    # The shingles of one length stand behind those of the others.
    pos, begin = F.col("nth"), F.lit(0)
    for g in grams[:-1]:
        begin = begin + F.greatest(F.lit(0), F.col("n_words") - (g - 1))
        pos = F.when(F.col("nth") >= begin, F.col("nth") - begin).otherwise(pos)
    return met.select("_id", "_k", "n_words", pos.alias("pos"), "token").distinct()


def find_overlaps(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, _id, _k, n_words, n_hit and items (array of item_id as strings, sorted) of every row of docs."""
    docs = keyed(docs)
    rows = docs.select("doc_id", "_id", "_k", F.coalesce(F.regexp_count("text", F.lit(ONE_WORD)), F.lit(0)).cast("long").alias("n_words"))
    windows = settled(item_windows(benchmark, width).withColumn("wid", F.xxhash64("words")))
    parts = windows.select("wid", F.size("words").alias("n"), _hashed(F.col("words")).alias("h")).dropDuplicates(["wid"])
    parts = parts.select("wid", "n", F.least("n", F.lit(gram)).alias("gram"), "h")
    parts = settled(parts)
    grams = sorted(r.gram for r in parts.select("gram").distinct().collect())  # ``gram`` different ones at most
    if not grams:
        return rows.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
    tokens = F.coalesce(*(F.when(F.col("gram") == g, _shingles(F.col("h"), g)) for g in grams))
    parts = settled(parts.select("wid", "n", "gram", F.posexplode_outer(tokens).alias("at", "token")))
    places = settled(_places(docs, settled(parts.select("token").distinct()), grams))

    counts = settled(places.groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    rarest = parts.join(counts, "token", "left").groupBy("wid", "n", "gram").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "at", "token")).alias("p"))
    prefix = settled(rarest.where("p.count > 0").select("wid", "n", F.expr("n - gram + 1").alias("needed"), "p.at", "p.token"))
    asked = places.join(prefix, "token").where("pos >= at and pos - at + n <= n_words")
    asked = asked.select("_id", "_k", "wid", "n", "needed", F.expr("pos - at").alias("start"))
    # Windows of one shingle are found with it; of the others every shingle has to be where it belongs.
    whole = asked.where("needed > 1").join(parts.select("wid", "at", "token"), "wid").withColumn("pos", F.col("start") + F.col("at"))
    whole = whole.join(places.drop("n_words"), ["_id", "_k", "pos", "token"], "left_semi").groupBy("_id", "_k", "wid", "n", "needed", "start").count().where("count = needed")
    found = settled(asked.where("needed = 1").unionByName(whole.drop("count")).select("_id", "_k", "wid", "start", "n"))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("n") - 1))))).cast("long").alias("n_hit")
    hits = found.groupBy("_id", "_k").agg(covered)
    items = found.select("_id", "_k", "wid").distinct().join(windows.select("wid", F.col("item_id").cast("string").alias("item")), "wid")
    items = items.groupBy("_id", "_k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = settled(hits.join(items, ["_id", "_k"]))
    return rows.join(found, ["_id", "_k"], "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def overlap_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    found = find_overlaps(docs, benchmark, width)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that hold no window of an item, with all their columns."""
    bad = settled(find_overlaps(docs, benchmark, width).where("n_hit > 0").select("_id", "_k", F.lit(True).alias("_bad")).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_k"))
    return left_join_few(rows, bad, ["_id", "_k"], F.xxhash64("_id", "_k")).where("_bad is null").select(*(F.col(f"row.`{c}`") for c in docs.columns))
