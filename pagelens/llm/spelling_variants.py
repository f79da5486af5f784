"""Spelling variants: words that one inserted, deleted or replaced code point tells apart, grouped under their forms.

Two words of one length differ in place i alone when they are equal without the code point there; a word is another one
with one code point more when it is equal to that one without some code point.  So a word's keys are hashes of the word
and of each of its deletions, those for replacements with their place.

1. ``count_words`` counts the words of all texts.
2. Keys come vectorised from prefix and suffix polynomial hashes of the words' code points: a deletion's hash is that of
   what stands before and of what stands behind, shifted by one place.  A key carries a number for its word, so a word
   of m code points has about 2 m keys of one size, however long it is.
3. Keys are dealt out by their highest bits and sorted.  Runs of one key are what may meet; all other keys go.
4. Runs are verified on the strings.  A run gives each of its words the number of its near words there and the one of the
   largest count; no pair of words is ever made.  Runs are small by their nature: two words in one differ in the same
   place, so that there is at most one for each letter and place.
5. A word's form is its near word of the largest count, if that is at least ``times`` as large as the word's own; counts
   grow along forms, so these end, and pointer doubling finds the last one, the root.

Cases: a null text has no words; a null doc_id counts as an empty one; repeated rows count as often as they stand there;
equal counts go by the order of code points; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import settled
from . import tokens
from .columns import ascii_lower

LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGE = 7, 2, 10, 31
_BASE = np.uint64(0x9E6C63D0876A3F6B)
_REPLACED, _PLACE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Code points of which keys are made at a time.
PART = 1 << 17
#: What ``at`` says of a key: the word itself; a place (from 0) for a replacement; -2 - place for a deletion.
WHOLE = -1


def count_words(docs: DataFrame, damage: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the runs ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased, with at least so many code points and occurrences.

    With ``damage``, runs for whose document and letters crc32 is divisible by it lose the code point at crc32 modulo length.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A run begins where no letter stands before, and a pattern that takes as many as it can takes all of it.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("word"))
    runs = runs.select("doc_id", ascii_lower(F.col("word")).alias("word"))
    if damage is not None:
        crc = F.crc32(F.concat("doc_id", F.lit(":"), "word").cast("binary"))
        place = (crc % F.char_length("word")).cast("int")
        less = F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.char_length("word")))
        runs = runs.select(F.when(crc % damage == 0, less).otherwise(F.col("word")).alias("word"))
    return runs.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, numbers of their words in the list, at) of the words' own keys, of replacements and of deletions."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    length = np.array([len(w) for w in words])
    end = np.cumsum(length)
    word = np.repeat(np.arange(len(words)), length)
    begin = (end - length)[word]
    g = np.arange(len(points))
    back = tokens.powers(tokens.inverse(_BASE), len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(tokens.mix(points.astype(np.uint64) + np.uint64(1)) * tokens.powers(_BASE, len(points)), out=sums[1:])
    prefix = (sums[g] - sums[begin]) * back[begin]
    suffix = (sums[end[word]] - sums[g + 1]) * back[begin] * back[1]
    short = prefix + suffix  # the word without the code point at g
    place = g - begin
    first = np.ones(len(points), bool)  # of equal neighbours, the first one stands for all
    first[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
    whole = (sums[end] - sums[end - length]) * back[end - length]
    keys = np.concatenate([tokens.mix(whole), tokens.mix(short * _REPLACED + (place.astype(np.uint64) + np.uint64(1)) * _PLACE), tokens.mix(short[first])])
    at = np.concatenate([np.full(len(words), WHOLE), place, -2 - place[first]])
    return keys, np.concatenate([np.arange(len(words)), word, word[first]]), at


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        total = np.cumsum([len(w) for w in words])
        i = 0
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PART, "right")))
            keys, word, at = deletion_keys(words[i:j])
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(ids[i:j][word]), pa.array(at.astype(np.int32))], ["key", "id", "at"])
            i = j


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end with the end of a run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = []
        elif held and held[-1].column("key")[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys at which words may meet: two replacements, or a word and a deletion."""
    for batch in _runs(batches):
        key, at = batch.column("key").to_numpy(), batch.column("at").to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        replaced, whole, deleted = (np.add.reduceat(x.astype(np.int64), begin) for x in (at >= 0, at == WHOLE, at < WHOLE))
        keep = np.flatnonzero(((replaced > 1) | ((whole > 0) & (deleted > 0)))[np.cumsum(new) - 1])
        if len(keep):
            yield batch.take(pa.array(keep))


def _without(word: str, at: int) -> str:
    return word if at == WHOLE else word[:at] + word[at + 1 :] if at >= 0 else word[: -2 - at] + word[-1 - at :]


def _found(same: list[tuple[int, str, int]]) -> Iterator[tuple[int, int, int, str, int]]:
    """(id, near words, count, word and id of the largest of them) of words that are near each other, given as (-n, word, id)."""
    same.sort()
    for k, (_, _, own) in enumerate(same):
        n, word, other = same[1 if k == 0 else 0]
        yield own, len(same) - 1, -n, word, other


_NEAR = "id long, near long, form_n long, form string, form_id long"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _NEAR.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    for batch in _runs(batches):
        groups: dict[tuple, list] = {}
        for key, at, own, word, n in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "id", "word", "n")), strict=True):
            groups.setdefault((key, max(at, WHOLE), _without(word, at)) if at >= 0 else (key, WHOLE, _without(word, at)), []).append((at, -n, word, own))
        out: list[tuple] = []
        for (_, kind, _), found in groups.items():
            if kind >= 0:
                if len(found) > 1:
                    out.extend(_found([x[1:] for x in found]))
                continue
            whole = [x[1:] for x in found if x[0] == WHOLE]
            longer = sorted(x[1:] for x in found if x[0] != WHOLE)
            if whole and longer:
                n, word, own = whole[0]
                out.append((own, len(longer), -longer[0][0], longer[0][1], longer[0][2]))
                out.extend((x[2], 1, -n, word, own) for x in longer)
        if out:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _dealt(keys: DataFrame) -> DataFrame:
    """Keys dealt out by their highest 16 bits and sorted."""
    return keys.repartition(F.shiftrightunsigned("key", 48)).sortWithinPartitions("key")


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root_id) for (id, to): each round follows twice as many forms."""
    forms = settled(forms)
    while True:
        on = forms.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        further = settled(forms.join(on, forms["to"] == on["_id"], "left").select("id", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
        forms = further.select("id", "to")
        if further.where("moved").isEmpty():
            return forms.withColumnRenamed("to", "root_id")


def group_variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of counts (word, n)."""
    words = settled(counts.select("word", F.col("n").cast("long").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    met = settled(_dealt(words.select("word", "id").mapInArrow(_keys, "key long, id long, at int")).mapInArrow(_met, "key long, id long, at int"))
    named = met.join(words, "id").select("key", "at", "id", "word", "n")
    near = _dealt(named).mapInArrow(_verified, _NEAR)
    best = near.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form", "form_id")).alias("best"))
    best = settled(best.select(F.col("id").alias("_id"), "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"), F.col("best.form_id").alias("form_id")))
    full = words.join(best, words["id"] == best["_id"], "left")
    large = F.col("form_n") >= times * F.col("n")
    full = settled(full.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(large, F.col(c)).alias(c) for c in ("form", "form_n", "form_id"))))
    roots = _roots(full.where("form_id is not null").select("id", F.col("form_id").alias("to")))
    roots = settled(roots.join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select(F.col("id").alias("_id"), "root"))
    return full.join(roots, full["id"] == roots["_id"], "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
