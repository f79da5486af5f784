"""Removal of repeated word windows by difference-cover anchors.

A window is ``width`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document.  A word goes if a window that
covers it also starts in a document of a smaller doc_id.

A difference cover D modulo v holds, for every d, two members a and b with a - b = d (mod v).  If the same window
starts at word i of one document and at word j of another, then for some k < v both i + k and j + k lie in D modulo
v.  So of the runs of ``width - v + 1`` words only those at positions in D (6 of every 31) are hashed and counted;
a run that occurs in two documents is an anchor that both know.  Each anchor is extended to the windows that
contain it, and only these are hashed whole and reduced to the smallest doc_id they start in.  Nothing is paired:
both steps are one aggregate and one join by hash, in which Spark combines before the shuffle and splits hot keys.

Cases: a null text has no words; a null doc_id is smaller than none and is never removed from; rows of one doc_id
count as one document, whatever their texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import settled
from . import tokens

WIDTH = 50
#: A perfect difference set: every residue modulo 31 but 0 is the difference of exactly one pair.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
_SECOND = 0xA0761D6478BD642F


def _anchors(first: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (word numbers of the run) and hashes of the anchors of all rows of a run."""
    short = width - MODULUS + 1
    starts = tokens.within_rows(first, short)
    if len(starts) == 0:
        return starts, np.empty(0, np.uint64)
    row = np.searchsorted(first, starts, "right") - 1
    cover = np.zeros(MODULUS, bool)
    cover[list(COVER)] = True
    starts = starts[cover[(starts - first[row]) % MODULUS]]
    return starts, tokens.rolling(hashes, short)[starts]


def _read(batch: pa.RecordBatch, name: str = "text"):
    for i, j, body, at in tokens.runs(batch.column(name)):
        starts, ends, first = tokens.words(body, at)
        yield i, j, body, starts, ends, first, tokens.hashed(body, starts, ends)


def _anchor_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, _, _, _, first, hashes in _read(batch):
                at, h = _anchors(first, hashes, width)
                doc = ids[i + np.searchsorted(first, at, "right") - 1]
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(doc.astype(np.int64))], ["h", "doc_id"])

    return rows


def _window_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            known = batch.column("anchors")
            for i, j, _, _, _, first, hashes in _read(batch):
                at, h = _anchors(first, hashes, width)
                shared = np.unique(known.slice(i, j - i).flatten().to_numpy(zero_copy_only=False))
                hit = np.zeros(len(hashes) + MODULUS + 1, np.int32)
                np.add.at(hit, at[np.isin(h.view(np.int64), shared)] + 1, 1)
                seen = np.cumsum(hit)
                starts = tokens.within_rows(first, width)
                starts = starts[seen[starts + MODULUS] > seen[starts]]
                doc = ids[i + np.searchsorted(first, starts, "right") - 1]
                one = tokens.rolling(hashes, width)[starts].view(np.int64) if len(starts) else np.empty(0, np.int64)
                two = (tokens.rolling(hashes, width, _SECOND)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(starts) else np.empty(0, np.int32)
                yield pa.record_batch([pa.array(one), pa.array(two), pa.array(doc.astype(np.int64))], ["h", "g", "doc_id"])

    return rows


def _kept_rows(width: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, gone, sha, kept = [], [], [], [], []
            ids, known, copy = batch.column("doc_id").to_pylist(), batch.column("gone"), batch.column("copy").to_pylist()
            for i, j, body, starts, ends, first, hashes in _read(batch):
                marked = np.zeros(len(hashes) + 1, np.int32)
                keys = known.slice(i, j - i)
                own = keys.flatten().to_numpy(zero_copy_only=False)
                if len(own):
                    lengths = np.diff(keys.offsets.to_numpy())
                    at = tokens.within_rows(first, width)
                    h = tokens.rolling(hashes, width)[at].view(np.int64) if len(at) else np.empty(0, np.int64)
                    row = np.searchsorted(first, at, "right") - 1
                    begin = np.cumsum(lengths) - lengths
                    for r in np.flatnonzero(lengths):
                        a, b = np.searchsorted(row, [r, r + 1])
                        cut = at[a:b][np.isin(h[a:b], own[begin[r] : begin[r] + lengths[r]])]
                        np.add.at(marked, cut, 1)
                        np.add.at(marked, cut + width, -1)
                out = np.cumsum(marked)[:-1] > 0
                raw = body.tobytes()
                for r in range(j - i):
                    a, b = int(first[r]), int(first[r + 1])
                    if copy[i + r] and b - a >= width:
                        out[a:b] = True
                    stay = np.flatnonzero(~out[a:b]) + a
                    if len(stay) == b - a:
                        text = b" ".join(raw[int(starts[a]) : int(ends[b - 1])].split()) if b > a else b""
                    else:
                        text = b" ".join(raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True))
                    doc.append(ids[i + r])
                    n.append(b - a)
                    gone.append(b - a - len(stay))
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode())
            columns = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.record_batch([*columns, pa.array(kept, pa.string())] if with_text else columns, [*names, "kept_text"] if with_text else names)

    return rows


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text of every row of docs."""
    if width <= MODULUS:
        raise ValueError(f"width must be over {MODULUS}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where(F.col("doc_id").isNotNull())
    anchors = named.mapInArrow(_anchor_rows(width), "h long, doc_id long")
    # Tables that rows are joined with are settled first: then Spark can split the join of a hot key.
    shared = settled(anchors.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h"))
    # A later copy of a whole text needs no windows: all of it starts in its first copy.
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    firsts = settled(keyed.groupBy("k").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"))
    copies = settled(keyed.join(firsts, "k").where("doc_id > low").select("doc_id", "k").distinct())
    marks = anchors.join(shared, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("anchors"))
    # A doc_id that has another text besides still needs its windows.
    more = keyed.join(copies, ["doc_id", "k"], "left_anti").join(copies.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")
    marks = settled(marks.join(copies.select("doc_id").join(settled(more), "doc_id", "left_anti").distinct(), "doc_id", "left_anti"))
    # Both steps on windows read them from a table: 20 bytes each, less than to deal out and hash the texts anew.
    windows = settled(named.join(marks, "doc_id").mapInArrow(_window_rows(width), "h long, g int, doc_id long"))
    lows = settled(windows.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "g", "low"))
    gone = settled(windows.join(lows, ["h", "g"]).where("doc_id > low").groupBy("doc_id").agg(F.collect_set("h").alias("gone")))
    info = gone.select("doc_id", "gone", F.lit(None).cast("string").alias("k")).unionByName(copies.select("doc_id", F.lit(None).cast("array<long>").alias("gone"), "k"))
    info = info.groupBy("doc_id").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.collect_set("k").alias("ks"))
    rows = docs.join(info, "doc_id", "left").select("doc_id", "text", F.coalesce("gone", F.array().cast("array<long>")).alias("gone"), F.coalesce(F.array_contains("ks", F.md5(F.col("text").cast("binary"))), F.lit(False)).alias("copy"))
    return rows.mapInArrow(_kept_rows(width, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
