"""Near-duplicates by min-max hashing.

A document's set has its distinct shingles of ``width`` words (5), A-Z lower-cased, words being
``[^\\x20\\x09-\\x0D]+``; with fewer words the whole sequence is the one shingle.  Two documents link when
100 * |A & B| >= ``percent`` * |A | B| (80).  The query op13 asks for 4 words and 80.

1. Equal sets are one node.  Each of PERMUTATIONS hash functions is evaluated once for each shingle and gives two values
   of the signature, the least and the greatest; minima and maxima make bands of their own, so no band holds both values
   of one function.  With ROWS values in a band and 2 * PERMUTATIONS / ROWS bands, a link of Jaccard 0.8 shares no band
   with a probability of about 1.3e-7 (0.67232 ** 40), a closer one with less; no link is missed otherwise.
2. In each bucket of a band all nodes are compared with one pivot, on their full sets, and those that link are joined:
   first in a few bands, then in the others wherever node and pivot are not joined yet.  The pivot is the node that meets
   most others in all its bands.
3. Buckets that still hold nodes of several groups are opened: nodes of different groups are compared, unless bitmaps of
   their sets exclude a link.  Tokens set bits of 2,048; bits in which two bitmaps differ come from different tokens, so
   that |A & B| <= (|A| + |B| - bits that differ) / 2, which the join tests before a pair is made.  Pairs inside of a
   group are never made, and a group of m copies takes m pairs.

Texts move only for nodes that share a bucket: a bitmap of fixed size drops the others as they are read.

Cases: a null or empty text has no set and links with nothing; rows of one doc_id count as one document if their texts
are equal and otherwise as rows with that id; a null doc_id stays in the result, with a null kept and, unless it links, a null
component;
an empty table gives an empty table; other columns are ignored.  Hashes of 64 bits stand for shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import settled
from . import tokens
from .columns import bitmap, maybe_in
from .components import connected_components
from .shingles import OVERLAPS, overlaps, set_name, sets

WIDTH, PERCENT, PERMUTATIONS, ROWS = 5, 80, 100, 5
#: Bands in which nodes are compared with pivots at first, and words of a bitmap.
FIRST_BANDS, WORDS = 8, 32
_rng = np.random.default_rng(20260113)
_TIMES = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_BAND = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(token: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Bands of each set: (sets, 2 * PERMUTATIONS / ROWS) hashes; tokens lie set by set and begin where ``begin`` says."""
    low = np.empty((PERMUTATIONS, len(begin)), np.uint64)
    high = np.empty_like(low)
    for p, times in enumerate(_TIMES):
        # Tokens are mixed words, so an odd multiple orders them anew; one evaluation serves both ends.
        value = token * times
        low[p] = np.minimum.reduceat(value, begin)
        high[p] = np.maximum.reduceat(value, begin)
    values = np.concatenate([low, high]).reshape(2 * PERMUTATIONS // ROWS, ROWS, len(begin))
    bands = (tokens.mix(values) * _IN_BAND[None, :, None]).sum(axis=1, dtype=np.uint64)
    return tokens.mix(bands + np.arange(len(bands), dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)).T


def _signed(width: int):
    count = 2 * PERMUTATIONS // ROWS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, token in sets(batch.column("text"), width):
                size = np.bincount(row, minlength=j - i)
                full = np.flatnonzero(size)
                bands = signatures(token, (np.cumsum(size) - size)[full]) if len(full) else np.empty((0, count), np.uint64)
                at = np.zeros(j - i + 1, np.int32)
                at[1:] = np.cumsum(np.where(size > 0, count, 0))
                listed = pa.ListArray.from_arrays(pa.array(at), pa.array(bands.ravel().view(np.int64)))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), batch.column("k").slice(i, j - i), pa.array(size), pa.array(set_name(row, token, size)), listed], ["doc_id", "k", "size", "node", "bands"])

    return rows


def _bitmaps(width: int):
    """node and the bits of its set, from its text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, token in sets(batch.column("text"), width):
                place = token % np.uint64(64 * WORDS)
                bits = np.zeros((j - i, WORDS), np.uint64)
                np.bitwise_or.at(bits, (row, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
                at = pa.array(np.arange(j - i + 1, dtype=np.int32) * WORDS)
                yield pa.record_batch([batch.column("node").slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(bits.ravel().view(np.int64)))], ["node", "bits"])

    return rows


def near_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, k (hash of the text), size (of the set) and c (a name of all that links reach; null without a set) of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    rows = settled(docs.mapInArrow(_signed(width), "doc_id long, k long, size long, node long, bands array<long>"))
    nodes = rows.where("size > 0 and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "k")).alias("first"), F.first("size").alias("n"), F.first("bands").alias("bands"))
    nodes = settled(nodes.select("node", "n", "bands", "first.*"))
    posted = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = settled(posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    met = settled(posted.join(shared, "bucket"))
    # The node that meets most others in all bands is the most typical one of its group, and its bucket's pivot.
    degrees = settled(met.groupBy("node").agg(F.sum("members").alias("degree")))
    pivots = met.join(degrees, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node", "n")).alias("p"))
    pivots = settled(pivots.select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("m")))
    met = settled(met.drop("members").join(pivots, "bucket"))

    wanted = settled(nodes.select("node", "doc_id", "k").join(met.select("node").distinct(), "node", "left_semi"))
    key = F.xxhash64("doc_id", "k")
    near = maybe_in(docs, key, bitmap(key, wanted)).join(wanted, ["doc_id", "k"]).select("node", "text")
    texts = settled(near.groupBy("node").agg(F.first("text").alias("text")) if _repeated(rows) else near)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return settled(pairs.mapInArrow(overlaps(width), OVERLAPS).where(f"100 * both >= {percent} * (n_a + n_b - both)").select("a", "b"))

    close = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    to_pivot = met.where("node <> pivot").where(close).select("band", "node", F.col("pivot").alias("other"))
    links = linked(to_pivot.where(F.col("band") < FIRST_BANDS).select("node", "other"))
    later = _apart(to_pivot.where(F.col("band") >= FIRST_BANDS).select("node", "other").distinct(), connected_components(links))
    links = links.unionByName(linked(later.select("node", "other")))

    held = met.join(connected_components(links), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("g"))
    mixed = settled(held.groupBy("bucket").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("bucket"))
    held = held.join(mixed, "bucket", "left_semi").join(texts.mapInArrow(_bitmaps(width), "node long, bits array<long>"), "node")
    held = settled(held)
    other = held.select("bucket", F.col("node").alias("other"), F.col("n").alias("m"), F.col("g").alias("h"), F.col("bits").alias("bits_o"))
    differ = F.aggregate(F.zip_with("bits", "bits_o", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    opened = held.join(other, "bucket").where("g < h").where(close).where((100 + percent) * (F.col("n") + F.col("m") - differ) >= 2 * percent * (F.col("n") + F.col("m")))
    links = links.unionByName(linked(opened.select("node", "other")))

    named = connected_components(links).select("node", "component")
    return rows.join(named, "node", "left").select("doc_id", "k", "size", F.when(F.col("size") > 0, F.coalesce("component", "node")).alias("c"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (node, other) that groups (node, component) do not join."""
    pairs = pairs.join(groups.withColumnRenamed("component", "g"), "node", "left")
    pairs = pairs.join(groups.select(F.col("node").alias("other"), F.col("component").alias("h")), "other", "left")
    return pairs.where(F.coalesce("g", "node") != F.coalesce("h", "other"))


def _repeated(rows: DataFrame) -> bool:
    return not rows.where("doc_id is not null").groupBy("doc_id", "k").count().where("count > 1").isEmpty()


def mark_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (it is that one) of every row of docs.

    ``ngram_join.keep_one_of_each_group(docs, classes=near_classes)`` gives the documents themselves.
    """
    full = near_classes(docs, width, percent)
    least = settled(full.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id")))
    out = full.join(least, "c", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
