"""Token counts by a public tokenizer, with huge documents encoded in overlapping chunks that are spliced.

A chunk is encoded with offsets and overlaps the next one.  Both agree from a proven boundary on: a place that the
tokenizer's pattern never spans, whatever stands before or after, and where both encodings end a token.  Such places stand
between a character that is no white space and one that is, and, for tokenizers that split text as GPT-2's does, behind a
run of letters or of digits.  The last such place before a chunk's end splices it with the next one, whose overlap is
widened to reach it.  A chunk without one grows to the next place that may be one, or to twice its length if that is more,
so that no text is encoded more than about twice.

Cases: a null text is an empty one, with 0 tokens; a null doc_id stays one; special strings inside texts are handled as the library does by
default; rows repeat as they are; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, LIMIT, TEXTS = 32768, 512, 512, 64
#: Overlaps that are tried before a chunk grows.
TRIES = 2


@lru_cache(maxsize=4)
def loaded(path: str):
    """The tokenizer of a file, one thread a task, without truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _classed(t) -> bool:
    """Whether the tokenizer's pattern ends a token behind every run of letters and of digits."""
    rule = json.loads(t.to_str()).get("pre_tokenizer") or {}
    return rule.get("type") == "ByteLevel" and bool(rule.get("use_regex", True))


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """L, N or o (other) where all versions of Unicode since 3.2 agree and no mark is meant, else ?."""
    kind = unicodedata.ucd_3_2_0.category(c)[0]
    return "?" if kind in "CM" and ord(c) > 127 or kind != unicodedata.category(c)[0] else kind if kind in "LN" else "o"


def _may_end(text: str, p: int, classed: bool) -> bool:
    """Whether the pattern never spans place p of text."""
    if text[p].isspace():
        return not text[p - 1].isspace()
    if not classed:
        return False
    before = _kind(text[p - 1])
    return before in "LN" and _kind(text[p]) not in (before, "?")


def _ends(t, text: str, a: int, b: int) -> list[int]:
    """Where the tokens of text[a:b] end, as offsets in text."""
    return [a + end for _, end in t.encode(text[a:b], add_special_tokens=False).offsets]


def spliced_count(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, classed: bool | None = None) -> int:
    """Tokens of text; chunks reach ``chunk`` characters further and overlap by ``overlap`` or more."""
    classed = _classed(t) if classed is None else classed
    counted, begin, stop = 0, 0, min(chunk, len(text))  # tokens before ``begin``; a proven boundary, or the start
    ends = _ends(t, text, begin, stop)
    while stop < len(text):
        known = set(ends)
        at, tried, p = None, 0, stop - 1
        while p > begin and tried < TRIES:
            if p not in known or not _may_end(text, p, classed):
                p -= 1
                continue
            low, high = max(begin, p - overlap), min(len(text), stop + chunk)
            after = _ends(t, text, low, high)
            new = set(after)
            at = next((x for x in range(p, low, -1) if x in known and x in new and _may_end(text, x, classed)), None)
            if at is not None:
                counted += bisect.bisect_right(ends, at)
                ends = after[bisect.bisect_right(after, at) :]
                begin, stop = at, high
                break
            tried, p = tried + 1, low
        if at is None:  # nothing proven in all of the chunk: it grows
            further = next((x for x in range(stop, len(text)) if _may_end(text, x, classed)), len(text))
            stop = min(len(text), max(2 * stop - begin, further + overlap))
            ends = _ends(t, text, begin, stop)
    return counted + len(ends)


def _counts(path: str, limit: int, chunk: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(path)
        classed = _classed(t)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                texts = [x or "" for x in part.column("text").to_pylist()]
                short = [i for i, x in enumerate(texts) if len(x) <= chunk]
                n = [0] * len(texts)
                for i, e in zip(short, t.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                    n[i] = len(e)
                for i in set(range(len(texts))) - set(short):
                    n[i] = spliced_count(t, texts[i], chunk, classed=classed)
                yield pa.record_batch([part.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counts(path, limit, chunk), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
