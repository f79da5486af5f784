"""JSON-LD of pages as rows: parsed to VARIANT and walked level by level on the JVM.

A block is told from what only looks like JSON by two parsers that differ in a few points: Spark's takes text behind the
value and refuses repeated keys, the reference rule is Python's.  Blocks on which they could differ, and those that nest
deeper than LEVELS, go through Python in Arrow batches; pages without a block, and all other blocks, never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonld as J
from ..functions.text import stripped
from .ordering import settled

LEVELS = 24
_STRING, _NUMBER = r'"(?:[^"\\]|\\.)*+"', r"-?[0-9][0-9.eE+-]*"
#: Numbers that both languages print alike, trailing zeros aside; of small fractions Python prints powers.
_PLAIN = r"-?(?:0|[1-9][0-9]{0,14})(?:\.(?!0000)[0-9]{1,6})?"
_NONE = "array<struct<key:string,value:string>>"


def _skeleton(text: Column) -> Column:
    """JSON without white space, with one character for each string and number: its length tells if anything stands beside the value."""
    bare = F.regexp_replace(F.regexp_replace(text, _STRING, '"'), _NUMBER, "0")
    return F.regexp_replace(bare, r"[ \t\r\n]", "")


def _alike(raw: Column, tree: Column) -> Column:
    """Whether both parsers take a block that Spark's takes, with the same values."""
    outside = F.regexp_replace(raw, _STRING, "")
    plain = ~F.regexp_replace(outside, rf"(?<![0-9.eE+-]){_PLAIN}(?![0-9.eE+-])", "").rlike("[0-9]")
    whole = F.length(_skeleton(raw)) == F.length(_skeleton(F.to_json(tree)))
    return plain & whole & ~raw.rlike(r"\\u[dD]") & ~outside.rlike(r"-0(?:[^.0-9]|$)")


def _shown(value: Column, kind: Column) -> Column:
    """A scalar as Python prints it; NULL for null, objects and arrays."""
    text = value.cast("string")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ".0")
    return F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.initcap(text)).when(kind.rlike("^(BIGINT|TINYINT|SMALLINT|INT)"), text).when(kind.rlike("^(DECIMAL|DOUBLE)"), F.when(text.contains("."), short).otherwise(text))


def _explode(frontier: DataFrame) -> DataFrame:
    """The members of each tree: page_id, block, under (the key that holds the tree), key and tree."""
    spark = frontier.sparkSession
    members = spark.tvf.variant_explode(F.col("tree").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    return frontier.lateralJoin(members).select("page_id", "block", F.col("key").alias("under"), F.col("_key").alias("key"), F.col("_value").alias("tree"))


def walked(trees: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """((page_id, block, under, key, kind, value) of all members of (page_id, block, tree), (page_id, block) that nest deeper than levels)."""
    kind = F.regexp_extract(F.schema_of_variant("tree"), r"^[A-Z]+", 0)
    frontier = trees.select("page_id", "block", F.lit(None).cast("string").alias("key"), "tree").where(F.schema_of_variant("tree").rlike("^(OBJECT|ARRAY)"))
    found = None
    for _ in range(levels):
        level = settled(_explode(frontier).withColumn("kind", kind))
        rows = level.select("page_id", "block", "under", "key", "kind", _shown(F.col("tree"), F.col("kind")).alias("value"))
        found = rows if found is None else found.unionByName(rows)
        frontier = level.where("kind in ('OBJECT', 'ARRAY')").select("page_id", "block", "key", "tree")
        if frontier.isEmpty():
            break
    return found, frontier.select("page_id", "block").distinct()


def page_facts(pages: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(page_id, ld) of pages (page_id, html) with HTML: struct<blocks, broken, types, pairs> as ``functions.jsonld.page_facts`` gives it."""
    listed = pages.select("page_id", J.blocks(F.col("html")).alias("raw")).where("raw is not null")
    some = settled(listed.where(F.size("raw") > 0).select("page_id", F.posexplode("raw").alias("block", "raw")).withColumn("raw", stripped(F.col("raw"))))
    parsed = some.withColumn("tree", F.try_parse_json("raw"))
    parsed = settled(parsed.withColumn("sure", F.coalesce(_alike(F.col("raw"), F.col("tree")), F.lit(False))))
    members, deep = walked(parsed.where("sure").select("page_id", "block", "tree"), levels)
    other = parsed.where("not sure").select("page_id", "block", "raw").unionByName(parsed.where("sure").join(deep, ["page_id", "block"], "left_semi").select("page_id", "block", "raw"))
    told = other.select("page_id", J.page_facts(F.concat(F.lit("<script application/ld+json>"), "raw", F.lit("</script>"))).alias("ld"))

    members = members.join(deep, ["page_id", "block"], "left_anti")
    is_type = F.coalesce((F.col("kind") == "STRING") & ((F.col("key") == "@type") | F.col("key").isNull() & (F.col("under") == "@type")), F.lit(False))
    types = members.where(is_type).select("page_id", F.col("value").alias("type"))
    pairs = members.where("key is not null and value is not null").select("page_id", "key", "value")
    types = types.unionByName(told.select("page_id", F.explode("ld.types").alias("type")))
    pairs = pairs.unionByName(told.select("page_id", F.explode("ld.pairs").alias("p")).select("page_id", "p.*"))
    counted = some.groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("blocks"))
    broken = told.groupBy("page_id").agg(F.sum("ld.broken").cast("int").alias("broken"))
    types = types.groupBy("page_id").agg(F.array_sort(F.collect_set("type")).alias("types"))
    pairs = pairs.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("pairs"))
    full = counted.join(broken, "page_id", "left").join(types, "page_id", "left").join(pairs, "page_id", "left")
    none, no_type = F.array().cast(_NONE), F.array().cast("array<string>")
    some_ld = full.select("page_id", F.struct("blocks", F.coalesce("broken", F.lit(0)).alias("broken"), F.coalesce("types", no_type).alias("types"), F.coalesce("pairs", none).alias("pairs")).alias("ld"))
    empty = F.struct(F.lit(0).alias("blocks"), F.lit(0).alias("broken"), no_type.alias("types"), none.alias("pairs"))
    return some_ld.unionByName(listed.where(F.size("raw") == 0).select("page_id", empty.alias("ld")))
