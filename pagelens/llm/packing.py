"""Packing of tokenised documents into fixed sequences, as a cutting-stock problem solved by column generation.

A document's ids are cut into pieces of the sequence length and a rest.  Lengths, rounded up to classes of ``GRAIN``
ids, make a histogram of fixed size.  A linear program chooses how often to use each pattern (a multiset of classes
that fits a sequence): columns enter one at a time, each the best pattern for the current prices, found by knapsack
dynamic programming.  The solution is rounded down and what is left is packed first-fit decreasing.  Pieces are ranked
in a global order of class, length and document, and a piece's rank in its class names its pattern, sequence and slot.

Only tokenizers that drop white space are taken: the ids of a text are then those of its words, each different word of
a run is looked up once, and only words that a worker has not met are encoded.

Cases: a null text is an empty one: its only id is the end id; a null doc_id stays one; rows repeat as they are; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ranked, settled
from . import tokens
from .token_counts import loaded

#: The program ends when no plan could use fewer sequences than this share less.
LENGTH, GRAIN, END_ID, STEPS, SLACK = 2048, 8, 1, 4000, 0.0005
#: Words, and bytes of them, whose ids a worker keeps; it starts anew when there are more.
CACHE, CACHE_BYTES, JOINED = 600_000, 64 << 20, 1000
# Fixed value: the pattern of a tokenizer whose words are cut further, where this pattern begins a new match.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, DIGIT, MARK = 1, 2, 3
#: Kinds of ASCII characters; 0 for white space, controls and bytes beyond ASCII.
KIND = np.array([0 if c < 33 or c > 126 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK for c in range(256)], np.int8)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Words:
    """Ids of the words that a worker has met, one after the other; it starts anew when they are too many."""

    def __init__(self, path: str):
        self.tokenizer = loaded(path)
        parts = json.loads(Path(path).read_text(encoding="utf-8"))
        self.added = [(t["content"].encode(), t["id"]) for t in parts["added_tokens"]]
        self.cuts_words = _pattern(parts) == PATTERN
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held, self.ids, self.ends = 0, np.empty(0, "<u4"), np.zeros(1, np.int64)

    def units(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The run's bytes, and starts, ends and first ones of its words; or of parts of words, lower-cased, for ``PATTERN``."""
        low = tokens.LOWER[body]
        if not self.cuts_words or any(text.lower() in low.tobytes() for text, _ in self.added):
            return body, *tokens.words(body, at)
        return low, *tokens.words(low, at, _cuts(low))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each of these different words."""
        if len(self.number) > CACHE or self.held > CACHE_BYTES:
            self.clear()
        new = [w for w in words if w not in self.number]
        for k in range(0, len(new), JOINED):
            part = new[k : k + JOINED]
            ids, count = self._encoded(part)
            self.number |= zip(part, range(len(self.number), len(self.number) + len(part)))
            self.held += sum(map(len, part))
            self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(count)])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has; an added token between two words parts them."""
        if self.added and not any(text in b" ".join(words) for text, _ in self.added):
            text, mark = self.added[0]
            ids = np.array(self.tokenizer.encode_batch_fast([text.join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(ids == mark)
            return ids[ids != mark], np.diff(marks, prepend=-1, append=len(ids)) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), "<u4"), np.array([len(x) for x in found], np.int64)

    def encoded(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, one after the other, and where each word's end."""
        begin, count = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        ends = np.cumsum(count)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)], ends


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def _cuts(body: np.ndarray) -> np.ndarray:
    """Before which bytes PATTERN surely begins a new match: between ASCII characters of different kinds, and digits.

    A letter after an apostrophe may be part of the apostrophe's match, and characters beyond ASCII may compose.
    """
    kind = KIND[body]
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(len(body), bool)
    cut[1:] = (before != after) & (before > 0) & (after > 0) & ~((body[:-1] == ord("'")) & (after == LETTER)) | (before == DIGIT) & (after == DIGIT)
    return cut


def _different(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each word of a run its place among the different ones, and these; words of one 64-bit hash count as one."""
    codes, found = pd.factorize(tokens.hashed(body, starts, ends))
    example = np.empty(len(found), np.int64)
    example[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    raw = body.tobytes()
    return codes, [raw[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]


def _pieces(path: str, length: int):
    """The ids of a text are those of its words, as ``splits`` has found of the tokenizer."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = _words(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, _, body, at in tokens.runs(batch.column("text")):
                out: list[tuple] = []
                body, starts, ends, first = known.units(body, at)
                codes, different = _different(body, starts, ends)
                flat, stop = known.encoded(known.numbers(different)[codes])
                cut = np.concatenate([[0], stop])[first].tolist()
                for row, (a, b) in enumerate(itertools.pairwise(cut)):
                    raw = flat[a:b].tobytes() + end
                    for k in range(0, b - a + 1, length):
                        part = raw[4 * k : 4 * (k + length)]
                        out.append((ids[i + row], k, len(part) // 4, zlib.crc32(part), b - a + 1))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows


def _flat(part: dict | None, key: str) -> list[dict]:
    return [] if part is None else part[key] if part["type"] == "Sequence" else [part]


def _pattern(parts: dict) -> str | None:
    """The pattern whose matches alone a tokenizer keeps."""
    cutter = (_flat(parts["pre_tokenizer"], "pretokenizers") or [{"type": None}])[0]
    return cutter["pattern"].get("Regex") if cutter["type"] == "Split" and cutter["behavior"] == "Removed" and cutter["invert"] else None


def splits(path: str) -> bool:
    """If the tokenizer drops white space and no token spans it: its ids are then those of the words between.

    Told from its parts: characters are only composed, lower-cased or replaced by a space where they are one, the text
    is cut by a pattern that leaves white space out, and no added token holds white space or reaches into it.
    """
    parts = json.loads(Path(path).read_text(encoding="utf-8"))
    plain = all(p["type"] in ("NFC", "Lowercase") or p["type"] == "Replace" and p["pattern"] == {"Regex": r"\s+"} and p["content"] == " " for p in _flat(parts["normalizer"], "normalizers"))
    apart = _pattern(parts) is not None and not any(c.isspace() for x in "\t\n\x0b\x0c\r " for m in regex.findall(_pattern(parts), f"a{x}1{x}.{x}'s{x}é{x}{x}") for c in m)
    return plain and apart and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"])


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The counts of classes that fit in room and are worth most (unbounded knapsack)."""
    worth, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        worth[c] = worth[c - 1]
        fits = np.flatnonzero(sizes <= c)
        if len(fits):
            value = worth[c - sizes[fits]] + prices[fits]
            k = int(value.argmax())
            if value[k] > worth[c] + 1e-12:
                worth[c], choice[c] = value[k], fits[k]
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return counts


def plan(sizes: np.ndarray, demand: np.ndarray, room: int, steps: int = STEPS) -> list[tuple[np.ndarray, int]]:
    """(counts of classes in a sequence, how many such sequences), covering the demand exactly."""
    m = len(sizes)
    patterns = np.diag(room // sizes).astype(float)  # a column each
    inverse = np.diag(1 / np.diag(patterns))
    level = inverse @ demand.astype(float)
    for _ in range(steps):
        prices = np.ones(m) @ inverse
        new = best_pattern(prices, sizes, room)
        if prices @ new <= 1 + SLACK:  # Farley's bound
            break
        change = inverse @ new
        ratio = np.where(change > 1e-9, level / np.where(change > 1e-9, change, 1), np.inf)
        k = int(ratio.argmin())
        if not np.isfinite(ratio[k]):
            break
        inverse[k] /= change[k]
        others = np.arange(m) != k
        inverse[others] -= np.outer(change[others], inverse[k])
        patterns[:, k] = new
        level = np.maximum(inverse @ demand, 0)
    used, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-level, kind="stable"):
        counts = patterns[:, k].astype(np.int64)
        held = counts > 0
        times = min(int(level[k] + 1e-9), int((left[held] // counts[held]).min())) if held.any() else 0
        if times:
            used.append((counts, times))
            left -= times * counts
    while left.any():  # first fit decreasing, the same pattern as often as it lasts
        counts, free = np.zeros(m, np.int64), room
        for i in np.argsort(-sizes, kind="stable"):
            take = min(int(left[i]), free // int(sizes[i]))
            counts[i] += take
            free -= take * int(sizes[i])
        held = counts > 0
        times = int((left[held] // counts[held]).min())
        used.append((counts, times))
        left -= times * counts
    return used


def pack(docs: DataFrame, path: str, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    if not splits(path):
        raise ValueError("the tokenizer has to drop white space, and none of its tokens may span it")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = F.ceil(F.col("length") / grain).cast("int")
    # Ranking reads its rows twice, so they are encoded into a table first.
    pieces = settled(docs.mapInArrow(_pieces(path, length), PIECES)).withColumn("kind", kind)
    placed = ranked(pieces, "kind", F.desc("length"), "doc_id", "start", "ids_crc32")
    histogram = dict(placed.groupBy("kind").count().collect())  # at most length / grain rows
    kinds = np.array(sorted(histogram), np.int64)
    slots, begin = [], {}
    if len(kinds):
        demand = np.array([histogram[k] for k in kinds], np.int64)
        begin = dict(zip(kinds.tolist(), (np.cumsum(demand) - demand).tolist(), strict=True))
        sequence, given = 0, dict.fromkeys(kinds.tolist(), 0)
        for counts, times in plan(kinds, demand, length // grain):
            for k, n in zip(kinds.tolist(), counts.tolist(), strict=True):
                if n:
                    slots.append((k, begin[k] + given[k], begin[k] + given[k] + n * times, n, sequence))
                    given[k] += n * times
            sequence += times
    table = F.broadcast(spark.createDataFrame(slots, "kind int, low long, high long, each long, first long"))  # classes of each pattern: bounded by the histogram
    spread = placed.join(table, (placed["kind"] == table["kind"]) & (placed["rank"] >= table["low"]) & (placed["rank"] < table["high"]))
    spread = spread.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long").alias("sequence_id"), "rank")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return spread.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("rank")
