"""Column expressions that the native operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import settled

#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the faster way."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def plain_words(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased; none for null."""
    return F.coalesce(F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != ""), F.array().cast("array<string>"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with keys that tell rows of one doc_id apart and hold for a null doc_id: _id and _k."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_k", F.xxhash64("text"))


#: Bits of a bitmap of keys: 262,144 rows of 64 at most, whatever the number of keys.
BITS = 1 << 24


def bitmap(keys: Column, df: DataFrame) -> DataFrame:
    """(_word, _bits): the bits that 64-bit keys of df set, combined before they are shuffled."""
    word, bit = _bit(keys)
    return df.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _bit(keys: Column) -> tuple[Column, Column]:
    place = F.pmod(keys, F.lit(BITS))
    return (place / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def maybe_in(df: DataFrame, keys: Column, bits: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key may be among those of the bitmap: all that are and few others, before anything moves.

    With ``how`` = left_anti the other rows.  The bitmap has at most BITS / 64 rows, whatever the number of keys.
    """
    word, bit = _bit(keys)
    return df.join(F.broadcast(bits), (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0), how)


def left_join_few(df: DataFrame, few: DataFrame, on: list[str], key: Column) -> DataFrame:
    """df left joined with few (one row for each value of ``on``): only rows that a bitmap of few's keys lets through are shuffled.

    ``key`` is a 64-bit key made of the columns ``on`` alone.  The plan is the same for any number of keys.
    """
    bits = settled(bitmap(key, few))
    met = maybe_in(df, key, bits).join(few, on, "left")
    return met.unionByName(maybe_in(df, key, bits, "left_anti"), allowMissingColumns=True).select(*df.columns, *(c for c in few.columns if c not in on))


def maybe_of(df: DataFrame, key: Column, tagged: DataFrame, tags: list[str], tag: str) -> DataFrame:
    """df with _tags, an array of those of ``tags`` under which tagged (key columns and ``tag``) may hold the row's key.

    Rows without any go.  One bitmap for each tag, side by side in a table of at most BITS / 64 rows; nothing is shuffled
    but the bits, so what must not be wrong has to be verified on the rows themselves.
    """
    word, bit = _bit(key)
    spread = tagged.select(word.alias("_word"), bit.alias("_bit"), F.col(tag).alias("_tag"))
    bits = spread.groupBy("_word").agg(F.array(*(F.coalesce(F.bit_or(F.when(F.col("_tag") == t, F.col("_bit"))), F.lit(0).cast("long")) for t in tags)).alias("_bits"))
    met = df.join(F.broadcast(settled(bits)), word == F.col("_word"))
    found = F.array_compact(F.array(*(F.when(F.get("_bits", F.lit(k)).bitwiseAND(bit) != 0, F.lit(t)) for k, t in enumerate(tags))))
    return met.select(*(F.col(f"`{c}`") for c in df.columns), found.alias("_tags")).where(F.size("_tags") > 0)
