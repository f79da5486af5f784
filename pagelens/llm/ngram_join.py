"""Jaccard self-join of documents on word shingles, by a token-group matrix.

A document's set has its distinct shingles of ``width`` words (5), A-Z lower-cased, words being
``[^\\x20\\x09-\\x0D]+``; with fewer words the whole sequence is the one shingle.  Two documents link when
100 * |A & B| >= ``percent`` * |A | B| (80).  The query op9 asks for 4 words and 85.

1. Equal sets are one node.  One pass counts shingles in a sketch of fixed size; its estimates put the tokens of all
   sets in one order, rare ones first.  The order only has to be the same everywhere, so an estimate that is too high
   costs time and no result.
2. Linked sets share one of their first n - ceil(n * percent / 100) + 1 tokens.  These are posted, and postings of tokens that a
   single node has are dropped.
3. Groups: each token names as pivot the node in which it comes earliest, that is the one with the fewest tokens of
   its own; nodes that truly link with a pivot form groups.  A group of m copies takes m pairs.
4. The matrix holds a row for each token and group: the union of the members' tokens with bounds of their sizes and of
   the tokens that can follow.  A node outside of the group meets it only within the sizes that could link, is held
   against these bounds, and only groups that could reach the overlap are opened, where pairs meet size and position
   bounds before their whole sets are compared.  Pairs inside of a group are known to be connected and are never made.

Cases: a null or empty text has no set and links with nothing; rows of one doc_id count as one document if their
texts are equal and otherwise as rows with that id; a null doc_id stays in the result with a null component unless it
links; an empty table gives an empty table; other columns are ignored.  Hashes of 64 bits stand for shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import settled
from . import tokens
from .columns import bitmap, maybe_in
from .components import connected_components
from .shingles import OVERLAPS, overlaps, set_name, sets

WIDTH, PERCENT = 5, 80
#: Cells of the sketch that orders tokens: 4 MB of counts, whatever the corpus; so many tasks' sketches are added up first.
SKETCH_BITS, BLOCKS, FAN = 20, 64, 256


def _survey(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "k", "size", "node", "block", "part", "counts"]
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("k")
            for i, j, row, token in sets(batch.column("text"), width):
                np.add.at(cells, (token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                size = np.bincount(row, minlength=j - i)
                yield pa.record_batch([ids.slice(i, j - i), keys.slice(i, j - i), pa.array(size), pa.array(set_name(row, token, size)), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names)
        if cells.any():
            for k, own in enumerate(_kept(cells).reshape(BLOCKS, -1)):
                yield pa.record_batch([*[pa.nulls(1, pa.int64())] * 4, pa.array([k], pa.int32()), pa.array([part // FAN], pa.int32()), pa.array([own.tobytes()], pa.binary())], names)

    return rows


def _kept(cells: np.ndarray) -> np.ndarray:
    """Counts as 32-bit numbers; beyond them the order of tokens no longer matters."""
    return np.minimum(cells, 2**31 - 1).astype(np.int32)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each block and part, of which a task holds a few at a time, as rows come sorted."""
    now, cells = None, None
    names = ["block", "part", "counts"]

    def out():
        return pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1] // FAN], pa.int32()), pa.array([_kept(cells).tobytes()], pa.binary())], names)

    for batch in batches:
        for k, part, raw in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            if now != (k, part):
                if now is not None:
                    yield out()
                now, cells = (k, part), np.zeros((1 << SKETCH_BITS) // BLOCKS, np.int64)
            cells += np.frombuffer(raw.as_buffer(), np.int32)
    if now is not None:
        yield out()


def _merged(sketches: DataFrame) -> DataFrame:
    """(block, part, counts): sketches of FAN parts as one."""
    dealt = sketches.repartition(BLOCKS, "block", "part").sortWithinPartitions("block", "part")
    return dealt.select("block", "part", "counts").mapInArrow(_summed, "block int, part int, counts binary")


def _postings(width: int, percent: int, sketch):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = sketch.value
        for batch in batches:
            for i, j, row, token in sets(batch.column("text"), width):
                size = np.bincount(row, minlength=j - i)
                node = set_name(row, token, size)
                token = token[np.lexsort((token, order_of[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], row))]
                at = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                keep = at < (size - -(-percent * size // 100) + 1)[row]
                row, token, at = row[keep], token[keep], at[keep]
                yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(node[row]), pa.array(size[row].astype(np.int32)), pa.array(at.astype(np.int32))], ["token", "node", "n", "at"])

    return rows


def _close(n: str, at: str, m: str, to: str, percent: int) -> str:
    """If sets of n and m tokens that first meet at positions at and to can overlap enough."""
    return f"100L * least({n}, {m}) >= {percent} * greatest({n}, {m}) and {100 + percent}L * least({n} - {at}, {m} - {to}) >= {percent}L * ({n} + {m})"


def linked_classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, k (hash of the text), size (of the set) and c (a name of all that links reach; null without a set) of every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    survey = settled(docs.mapInArrow(_survey(width), "doc_id long, k long, size long, node long, block int, part int, counts binary"))
    rows = survey.where("block is null").select("doc_id", "k", "size", "node")
    cells = np.zeros((BLOCKS, (1 << SKETCH_BITS) // BLOCKS), np.int64)
    # Tasks' sketches are added up FAN at a time, and those sums again; what is left comes to the driver.
    for r in _merged(_merged(survey.where("block is not null").select("block", "part", "counts"))).toLocalIterator():
        cells[r.block] += np.frombuffer(r.counts, np.int32)
    sketch = spark.sparkContext.broadcast(np.minimum(cells.ravel(), 2**31 - 1).astype(np.int32))

    posted = docs.where("text is not null").select("text").mapInArrow(_postings(width, percent, sketch), "token long, node long, n int, at int")
    met = settled(posted.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token"))
    posted = settled(posted.join(met, "token", "left_semi").groupBy("token", "node").agg(F.first("n").alias("n"), F.first("at").alias("at")))

    nodes = rows.where("size > 0 and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "k")).alias("first")).select("node", "first.*")
    wanted = settled(nodes.join(posted.select("node").distinct(), "node", "left_semi"))
    # Only texts whose row a bitmap of fixed size lets through are shuffled.
    key = F.xxhash64("doc_id", "k")
    wanted = maybe_in(docs, key, bitmap(key, wanted)).join(wanted, ["doc_id", "k"]).select("node", "text")
    texts = settled(wanted.dropDuplicates(["node"]) if _repeats(rows, "doc_id") else wanted)

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return settled(pairs.mapInArrow(overlaps(width), OVERLAPS).where(f"100 * both >= {percent} * (n_a + n_b - both)").select("a", "b"))

    pivots = posted.groupBy("token").agg(F.min(F.struct("at", "n", "node")).alias("p")).select("token", F.col("p.node").alias("other"), F.col("p.n").alias("m"), F.col("p.at").alias("to"))
    links = compared(posted.join(pivots, "token").where("node <> other").where(_close("n", "at", "m", "to", percent)))
    groups = connected_components(links)

    held = posted.join(groups, "node", "left").select("token", "node", "n", "at", F.coalesce("component", "node").alias("g"))
    mixed = settled(held.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("token"))
    held = settled(held.join(mixed, "token", "left_semi"))
    matrix = held.groupBy("token", "g").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("rest"))
    asked = held.join(matrix.select("token", "g", F.col("members").alias("own")), ["token", "g"])
    # Sizes fall into classes of the ratio that linked sets may differ by; a node meets the groups of its class alone, so
    # that a token of many groups is dealt out by their sizes and meets no group that is too small or too large.
    level = lambda x: F.log(F.col(x)) / math.log(100 / min(percent, 99))
    classed = matrix.withColumnRenamed("g", "h").select("*", F.explode(F.sequence(F.floor(level("fewest") - 1 - 1e-9).cast("int"), F.floor(level("most") + 1 + 1e-9).cast("int"))).alias("class"))
    groups_met = asked.withColumn("class", F.floor(level("n")).cast("int")).join(classed, ["token", "class"]).where("g <> h and (own < members or own = members and g < h)")
    # The smallest partner that could link bounds the overlap that is needed; the largest rest bounds the overlap there is.
    groups_met = groups_met.where(f"100L * most >= {percent} * n and 100L * n >= {percent} * fewest and {100 + percent}L * least(n - at, rest) >= {percent}L * (n + greatest(fewest, ceil({percent} * n / 100)))")
    opened = groups_met.select("token", "node", "n", "at", "h").join(held.select("token", F.col("g").alias("h"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("at").alias("to")), ["token", "h"]).where(_close("n", "at", "m", "to", percent))
    links = links.unionByName(compared(opened))

    named = connected_components(links).select("node", "component")
    return rows.join(named, "node", "left").select("doc_id", "k", "size", F.when(F.col("size") > 0, F.coalesce("component", "node")).alias("c"))


def link_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row of docs."""
    full = linked_classes(docs, width, percent)
    least = settled(full.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id")))
    return full.join(least, "c", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _repeats(rows: DataFrame, *key: str) -> bool:
    return not rows.where("doc_id is not null").groupBy(*key).count().where("count > 1").isEmpty()


def keep_one_of_each_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, classes: Callable[[DataFrame, int, int], DataFrame] = linked_classes) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id; all columns stay.

    It is the text that goes or stays: of a doc_id with several texts each is decided by its own group, and if the
    smallest doc_id of a group has several texts in it, one of them stays.  Of rows of equal doc_id and text one stays.
    Rows without a doc_id or without a set (null and empty texts) all stay.  ``classes`` finds the groups.
    """
    found = settled(classes(docs, width, percent))
    named = found.where("doc_id is not null and c is not null")
    first = settled(named.groupBy("c").agg(F.min(F.struct("doc_id", "k")).alias("first")))
    gone = named.join(first, "c").where(F.struct("doc_id", "k") > F.col("first")).select(F.col("doc_id").alias("_gone"), F.col("k").alias("_text")).distinct()
    kept = docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_text"]), "left_anti")
    if not _repeats(found, "doc_id", "k"):
        return kept
    # Rows that are repeated are few beside the others, which need not be dealt anew.
    many = settled(found.where("doc_id is not null").groupBy("doc_id", "k").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("k").alias("_k")))
    same = (kept["doc_id"].cast("long") == many["_id"]) & (F.xxhash64(kept["text"].cast("string")) == many["_k"])
    return kept.join(many, same, "left_anti").unionByName(kept.join(many, same, "left_semi").dropDuplicates(["doc_id", "text"]))
