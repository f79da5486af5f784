"""Vectorised words and hashes of Arrow text columns.

Text columns are walked in runs of whole rows of about one MB, so that the arrays made of a run stay small
whatever the batch size is; a single text larger than that is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words after which every bit depends on all (splitmix64's finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in these bytes); a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, body = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, body[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(body: np.ndarray, at: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each row (one more entry than rows).

    Words also end before each byte at which ``cuts`` is set.
    """
    n = len(body)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    space = SPACE[body]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[0] = edge[n] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    if cuts is not None:
        before |= cuts
        after[:-1] |= cuts[1:]
    starts = np.flatnonzero(before & ~space)
    return starts, np.flatnonzero(after & ~space) + 1, np.searchsorted(starts, at)


def hashed(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    pow_ = powers(_BASE, int(lengths.max()))
    letters = body[within + np.repeat(starts, lengths)]
    return mix(np.add.reduceat(_BYTE[letters] * pow_[within], first) + lengths.astype(np.uint64))


def rolling(values: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` values (len(values) - width + 1 of them)."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    b = np.uint64(base)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(b, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(inverse(b), n)[: n - width + 1])


def within_rows(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of the runs of ``width`` words that lie in one row, given ``words()``'s first words."""
    n = int(first[-1]) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    ok = np.zeros(int(first[-1]) + 1, np.int32)
    full = np.flatnonzero(np.diff(first) >= width)
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, first[1:][full] - width + 1, -1)
    return np.flatnonzero(np.cumsum(ok)[:-1] > 0)
