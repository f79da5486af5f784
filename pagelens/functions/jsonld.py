"""JSON-LD blocks, parsed strictly and walked; the one place where pages go through Python, in Arrow batches.

JSON has to be told from what only looks like it (a trailing comma breaks a block, and then search engines ignore all
of it), so a block is parsed as a whole and its values are taken from the tree, however deep they are.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import extract_all

BLOCK = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
RAW_CHARS = 2000
_PAIRS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
FACTS = T.StructType([T.StructField("blocks", T.IntegerType()), T.StructField("broken", T.IntegerType()), T.StructField("types", T.ArrayType(T.StringType())), T.StructField("pairs", _PAIRS)])
NAMES = FACTS.names


def _text(x) -> str:
    """x in print; a half of a surrogate pair, which no text can hold, becomes a question mark."""
    return str(x).encode("utf-8", "replace").decode()


def _walked(tree) -> tuple[list[str], list[dict]]:
    """Types, and scalar values with their keys, of all objects of a tree."""
    types, pairs, left = [], [], [tree]
    while left:
        node = left.pop()
        if isinstance(node, dict):
            kind = node.get("@type")
            types += [_text(kind)] if isinstance(kind, str) else [_text(k) for k in kind if isinstance(k, str)] if isinstance(kind, list) else []
            pairs += [{"key": _text(k), "value": _text(v)} for k, v in node.items() if isinstance(v, str | int | float)]
            left += node.values()
        elif isinstance(node, list):
            left += node
    return types, pairs


def _facts(blocks: list[str] | None, limit: int | None) -> dict | None:
    if blocks is None:
        return None
    types, pairs, broken = set(), [], 0
    for raw in blocks:
        try:
            found, values = _walked(json.loads(raw.strip()))
            types.update(found)
            pairs += values
        except (ValueError, RecursionError):
            # A broken block counts for nothing, but its types are told.
            broken += 1
            types.update(re.findall(r'"@type"\s*:\s*"([^"]+)"', raw.strip()[:limit]))
    return {"blocks": len(blocks), "broken": broken, "types": sorted(types), "pairs": pairs}


def _frame(column: pd.Series, limit: int | None) -> pd.DataFrame:
    rows = [_facts(None if b is None else list(b), limit) or dict.fromkeys(NAMES) for b in column]
    return pd.DataFrame(rows, columns=NAMES).astype({"blocks": "Int32", "broken": "Int32"})


@F.pandas_udf(FACTS)
def _page(blocks: pd.Series) -> pd.DataFrame:
    return _frame(blocks, RAW_CHARS)


@F.pandas_udf(FACTS)
def _draft(blocks: pd.Series) -> pd.DataFrame:
    return _frame(blocks, None)


def blocks(html: Column) -> Column:
    return extract_all(html, BLOCK)


def facts_of(blocks: Column) -> Column:
    """``page_facts`` of blocks that were taken from a page before."""
    return _page(blocks)


def no_facts() -> Column:
    """``page_facts`` of a page without a block, without Python."""
    return F.struct(F.lit(0).alias("blocks"), F.lit(0).alias("broken"), F.array().cast("array<string>").alias("types"), F.array().cast("array<struct<key:string,value:string>>").alias("pairs"))


def page_facts(html: Column) -> Column:
    """struct<blocks, broken, types, pairs> of the JSON-LD of a page; of a broken block the types in its first characters."""
    return _page(blocks(html))


def draft_facts(html: Column) -> Column:
    """The same of a draft, where a broken block is read to its end."""
    return _draft(blocks(html))
