"""Shards cut from a Hilbert curve through several metadata dimensions, in DataFrame functions alone.

Language, source and the logarithm of the size are quantised to 16 steps each, in order: a text dimension is cut at
sixteenths of its values, by their first seven bytes; sizes by their power of two.  A table of the curve's 4,096 cells,
made from a rule, gives each row's place; rows are ordered by place, hash of the text and doc_id, ranked without a
single task, and cut into runs.  Neighbours on the curve are neighbours in every dimension, so that a shard covers a
narrow range of each and a reader can skip files by any of them.

The law is ``rows``: the counts of two shards differ by one at most.  Equal texts stand side by side: if their
languages or sources differ, all of them take the first of their places.

Cases: a null text has size 16; nulls of language and source are a step of their own, the first; a null doc_id stays
one; rows repeat as they are; with fewer rows than shards some shards are empty; an empty table gives an empty table.  ``shard_documents`` puts
size, shard and slot behind the columns of docs and refuses docs that already have one of these; other names never
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ranked, settled
from .columns import left_join_few

BITS, SHARDS, TEXTS = 4, 40, ("lang", "source")


def hilbert_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """Place of a cell on the curve that visits each cell of the cube once, moving by one step in one dimension.

    Coordinates are turned into the curve's own frame from the highest bit down: where a bit is set the lower bits of
    the first axis are mirrored, and otherwise swapped with those of the first axis.  Then they are Gray-decoded.
    """
    x = list(point)
    high = 1 << (bits - 1)
    bit = high
    while bit > 1:
        low = bit - 1
        for i in range(len(x)):
            if x[i] & bit:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, bit = 0, high
    while bit > 1:
        if x[-1] & bit:
            flip ^= bit - 1
        bit >>= 1
    x = [v ^ flip for v in x]
    place = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            place = place << 1 | v >> b & 1
    return place


def _leading(text: Column) -> Column:
    """The first seven bytes as a number, in the order of the texts; null for null."""
    return F.conv(F.rpad(F.substring(F.hex(text.cast("binary")), 1, 14), 14, "0"), 16, 10).cast("long")


def _keys(docs: DataFrame, *own: Column) -> DataFrame:
    """``own``, _id, _bytes, _hash and the numbers of the text dimensions of every row of docs."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    numbers = [(_leading(F.col(c).cast("string")) if c in docs.columns else F.lit(None).cast("long")).alias(f"_{c}_key") for c in TEXTS]
    return docs.select(*own, F.col("doc_id").cast("long").alias("_id"), size.alias("_bytes"), F.xxhash64(text).alias("_hash"), *numbers)


def _placed(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with _place; facts is a table of the same keys, from which the steps and the places of equal texts are taken."""
    side = 1 << BITS
    cells = [(a, b, c, hilbert_index((a, b, c))) for a in range(side) for b in range(side) for c in range(side)]
    curve = F.broadcast(rows.sparkSession.createDataFrame(cells, "_lang int, _source int, _size int, _place int"))  # always 4,096 rows
    shares = [k / (side - 1) for k in range(1, side - 1)]
    cuts = facts.agg(*(F.percentile_approx(f"_{c}_key", shares, 100_000).alias(c) for c in TEXTS)).first()  # 14 numbers each
    # A value's step tells how many of the cuts it is beyond, so that a frequent value does not share one with the next.
    steps = {c: F.coalesce(sum((F.col(f"_{c}_key") > x).cast("int") for x in sorted(set(cuts[c] or []))) + F.when(F.col(f"_{c}_key").isNotNull(), 1), F.lit(0)) for c in TEXTS}
    level = F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(F.log2("_bytes")) - 4)).cast("int")

    def on_curve(df: DataFrame) -> DataFrame:
        df = df.select("*", level.alias("_size"), *(steps[c].alias(f"_{c}") for c in TEXTS))
        return df.join(curve, ["_lang", "_source", "_size"]).drop("_lang", "_source", "_size", *(f"_{c}_key" for c in TEXTS))

    apart = on_curve(facts).groupBy("_hash").agg(F.min("_place").alias("_first"), F.max("_place").alias("_last")).where("_first < _last")
    apart = settled(apart.select("_hash", "_first"))
    return left_join_few(on_curve(rows), apart, ["_hash"], F.xxhash64("_hash")).withColumn("_place", F.coalesce("_first", "_place")).drop("_first")


def _cut(rows: DataFrame, shards: int) -> DataFrame:
    placed = ranked(rows, "_place", "_hash", "_id")
    total = max(placed.count(), 1)
    placed = placed.withColumn("_shard", F.expr(f"int(rank * {shards}L div {total}L)"))
    return placed.withColumn("_slot", F.expr(f"rank - (_shard * {total}L + {shards - 1}L) div {shards}L"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with size, shard and slot, to be written by ``write_shards``."""
    if taken := {"size", "shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have columns {sorted(taken)} already")
    rows = _keys(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"))
    rows = _cut(_placed(rows, settled(_keys(docs))), shards)
    return rows.select("_all.*", F.col("_bytes").alias("size"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """A folder for each shard, its rows in curve order, for readers that skip files by column ranges."""
    sharded = shard_documents(docs, shards)
    sharded.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard; the texts themselves are not moved."""
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = settled(_keys(docs, crc.alias("_crc")))
    rows = _cut(settled(_placed(rows, rows)), shards)
    return rows.select(F.col("_id").alias("doc_id"), F.col("_bytes").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
