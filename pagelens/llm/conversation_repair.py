"""Repair of conversations whose turns are lost, empty, doubled, cut off or under the wrong role.

A repaired conversation's role initials read ``(s?(ua)+)?``.  The edits are Keep (0), Rerole to user or assistant (1),
Delete (2, the only edit of blank and repeated rows) and Insert of an empty user or assistant turn (5); a truncated row
that is not deleted adds 5.  A forward Viterbi pass over each conversation's rows, in order, carries for each of the four
states of the grammar (nothing yet, after system, after user, after assistant) the least (cost, audit), the audit being the
initials of the edits so far; each row's layer is closed with at most two inserts, after which the states repeat.

Two audits of one cost over the same rows are never prefixes of each other, as inserts cost, so the lesser one stays the
lesser whatever follows and the pass may drop the other.

- ``mark_faults`` finds blank, repeated and truncated rows.  Texts do not move: digests of 16 bytes stand for them.
- ``audit_conversations`` makes the pass over one short row per message.  Rows that are equal in all columns are one row
  with a number.  A task streams its conversations, holding four short tails and the links behind them.
- ``repaired_turns`` streams the texts once, behind their conversation's audit, and gives the repaired turns in order.

A conversation's order and its digest go from end to end, so one task reads it, in batches; no task holds one.

Cases: rows of a conversation are ordered by turn (nulls first), then role, then the text's MD5; a null role or text is
one space; rows of a null conv_id are one conversation; roles other than s*, u* and a* are reroled or deleted; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import settled

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Where a kept initial leads from each state (nothing yet, after s, after u, after a); the codes are s, u, a, other.
NEXT = [[1, 2, None, None], [None, 2, None, None], [None, None, 3, None], [None, 2, None, None]]
ROLES = {1: "system", 2: "user", 3: "assistant"}
#: Rows after which the tails of audits are linked away.
TAIL = 256


def messages(conversations: DataFrame) -> DataFrame:
    """The rows as the operator takes them: typed, without nulls in role and text, each with the number of its copies (1)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, F.lit(1).alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``messages`` with faults put in by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space)."""
    rows = messages(conversations)
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, 2).otherwise(1)
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def mark_faults(rows: DataFrame) -> DataFrame:
    """A short row for each different row: conv_id, turn, role, digest, n, blank, truncated, later (role and text came earlier)."""
    seen = r"[^\x20\x09-\x0D]"
    blank = ~F.col("text").rlike(seen)
    short = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), blank.alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"), "copies")
    short = settled(short.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.sum("copies").alias("n")))
    # A null turn comes first, as a struct of (not null, turn) says too.
    place = F.struct(F.col("turn").isNotNull().alias("set"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = short.groupBy("conv_id", "role", "digest").agg(F.count(F.lit(1)).alias("_m"), F.min(place).alias("_first")).where("_m > 1")
    again = settled(again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    return short.join(again, same, "left").withColumn("later", F.col("_first").isNotNull() & (place != F.col("_first"))).drop("_c", "_r", "_d", "_first")


Layer = list  # for each state None or (cost, links, tail); links are (links before, tail) or None


def _less(a: tuple, b: tuple) -> bool:
    """If (cost, audit) of a is less; links are walked back only to where both come from."""
    if a[0] != b[0]:
        return a[0] < b[0]
    p, x, q, y = a[1], a[2], b[1], b[2]
    while p is not q:
        p, x, q, y = p[0], p[1] + x, q[0], q[1] + y
    return x < y


def _offer(layer: Layer, state: int, found: tuple) -> None:
    if layer[state] is None or _less(found, layer[state]):
        layer[state] = found


def closed(layer: Layer) -> Layer:
    """The layer with inserts: to user from all states but user, to assistant from user; a third one would be of no use."""
    for _ in range(2):
        for s, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if layer[s] is not None:
                cost, links, tail = layer[s]
                _offer(layer, to, (cost + INSERT, links, tail + "I"))
    return layer


def start() -> Layer:
    return closed([(0, None, ""), None, None, None])


def advanced(layer: Layer, code: int, forced: bool, truncated: bool, n: int) -> Layer:
    """The layer after n equal rows, of which all but the first, and if forced the first as well, have to be deleted."""
    new: Layer = [None] * 4
    more = "D" * (n - 1)
    extra, stay = DELETE * (n - 1), TRUNCATED * truncated
    for s, best in enumerate(layer):
        if best is None:
            continue
        cost, links, tail = best
        cost += extra
        _offer(new, s, (cost + DELETE, links, tail + "D" + more))
        if not forced:
            to = NEXT[s][code]
            if to is not None:
                _offer(new, to, (cost + stay, links, tail + "K" + more))
            _offer(new, 3 if s == 2 else 2, (cost + REROLE + stay, links, tail + "R" + more))
    return closed(new)


def linked(layer: Layer) -> Layer:
    return [x and (x[0], (x[1], x[2]), "") for x in layer]


def ended(layer: Layer) -> tuple[int, str]:
    """(cost, audit) of the conversation: it ends empty or after an assistant."""
    best = layer[0]
    if layer[3] is not None and (best is None or _less(layer[3], best)):
        best = layer[3]
    cost, links, tail = best
    parts = [tail]
    while links is not None:
        links, tail = links
        parts.append(tail)
    return cost, "".join(reversed(parts))


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Pass:
    """The pass over one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.layer, self.rows = conv_id, start(), 0
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = ""

    def row(self, turn, initial, blank, truncated, later, n):
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        again = n if later else n - 1
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else again
        self.truncated += int(truncated and not blank and not later)
        self.illegal += n - 1 + (self.rows > 0 and self.before + initial not in ("su", "ua", "au"))
        self.before = initial
        code = "sua".find(initial) if initial else 3
        self.layer = advanced(self.layer, code if code >= 0 else 3, blank or later, truncated, n)
        if self.rows // TAIL != (self.rows + n) // TAIL:
            self.layer = linked(self.layer)
        self.rows += n

    def result(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *ended(self.layer))


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _AUDIT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]

    def batch_of(rows):
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    now, done, held = None, [], 0
    for batch in batches:
        for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "truncated", "later", "n")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                    held += len(done[-1][-1])
                now = _Pass(conv_id)
            now.row(*row)
            if len(done) >= 4096 or held > 1 << 22:
                yield batch_of(done)
                done, held = [], 0
    if now is not None:
        done.append(now.result())
    if done:
        yield batch_of(done)


def audit_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation that has rows."""
    marked = mark_faults(rows).withColumn("initial", F.substring("role", 1, 1))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = marked.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "initial", "blank", "truncated", "later", "n").mapInArrow(_passes, _AUDIT)


_TURNS = "conv_id long, place long, edit string, role string, text string"


class _Turns:
    """The repaired turns of one conversation, from its audit and its rows in order."""

    def __init__(self, conv_id, audit):
        self.conv_id, self.audit, self.at, self.state, self.place = conv_id, audit, 0, 0, 0

    def _turn(self, edit, role, text):
        self.place += 1
        return self.conv_id, self.place - 1, edit, role, text

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = 3 if self.state == 2 else 2
            yield self._turn("I", ROLES[self.state], "")

    def row(self, role, text, copies):
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = NEXT[self.state]["sua".index(role[0])]
                yield self._turn("K", role, text)
            elif edit == "R":
                self.state = 3 if self.state == 2 else 2
                yield self._turn("R", ROLES[self.state], text)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _TURNS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    now, out = None, []

    def batch_of():
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for conv_id, audit, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")), strict=True):
            if audit is not None:  # the audit comes before its conversation's rows
                if now is not None:
                    out.extend(now.inserted())
                now = _Turns(conv_id, audit)
            else:
                out.extend(now.row(role, text, copies))
            if len(out) >= 512:
                yield batch_of()
                out = []
    if now is not None:
        out.extend(now.inserted())
    if out:
        yield batch_of()


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), role and text; a conversation's turns are in one partition, in order."""
    texts = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", _digest("text").alias("digest"), "text", "copies")
    null = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"), ("copies", "int"))]
    both = texts.unionByName(audits.select("conv_id", "audit", *null)).withColumn("later", F.col("audit").isNull())
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "later", "turn", "role", "digest")
    return dealt.select("conv_id", "audit", "role", "text", "copies").mapInArrow(_turns, _TURNS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, done = None, None, []

    def batch_of():
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*done, strict=True), (pa.int64(), pa.string()), strict=True)], ["conv_id", "sha256"])

    for batch in batches:
        for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = conv_id, hashlib.sha256()
            state.update((f"{role}:{text}" if place == 0 else f"\n{role}:{text}").encode())
        if done:
            yield batch_of()
            done = []
    if state is not None:
        done.append((now, state.hexdigest()))
        yield batch_of()


def repair_report(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """For each of conv_ids its faults, cost, audit and the SHA-256 of its repaired turns as ``role:text`` lines."""
    audits = settled(audit_conversations(rows))
    hashes = repaired_turns(rows, audits).mapInArrow(_digests, "conv_id long, sha256 string").withColumnRenamed("conv_id", "_h")
    faults = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conv_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(audits.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    # A null conversation has no row in hashes only if nothing of it is left, and then _h is null without a hash.
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in faults), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
