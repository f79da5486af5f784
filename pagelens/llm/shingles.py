"""Sets of word shingles of Arrow text columns, shared by the joins on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import tokens


def sets(column: pa.Array, width: int):
    """(first row, end row, row, token): the distinct tokens of each row of a run, sorted by row and token."""
    for i, j, body, at in tokens.runs(column):
        body = tokens.LOWER[body]
        starts, ends, first = tokens.words(body, at)
        hashes = tokens.hashed(body, starts, ends)
        begin = tokens.within_rows(first, width)
        token = tokens.rolling(hashes, width)[begin] if len(begin) else np.empty(0, np.uint64)
        row = np.searchsorted(first, begin, "right") - 1
        count = np.diff(first)
        for few in range(1, width):
            alone = np.flatnonzero(count == few)
            if len(alone):
                token = np.concatenate([token, tokens.rolling(hashes, few, 0x8CB92BA72F3D8DD7 + 2 * few)[first[:-1][alone]]])
                row = np.concatenate([row, alone])
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        yield i, j, row[new], token[new]


def set_name(row: np.ndarray, token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens.mix(token ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
    end = np.cumsum(size)
    return tokens.mix((sums[end] - sums[end - size]) + size.astype(np.uint64)).view(np.int64)


def overlaps(width: int):
    """Of pairs (a, b, text_a, text_b): the sizes of both sets and of what they share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, own = batch.slice(k, 64), []
                for name in ("text_a", "text_b"):
                    found: list[np.ndarray] = []
                    for i, j, row, token in sets(part.column(name), width):
                        found += np.split(token, np.searchsorted(row, np.arange(1, j - i)))
                    own.append(found)
                n = [(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))) for x, y in zip(*own, strict=True)]
                yield pa.record_batch([part.column("a"), part.column("b"), *(pa.array(x, pa.int64()) for x in zip(*n, strict=True))], ["a", "b", "n_a", "n_b", "both"])

    return rows


OVERLAPS = "a long, b long, n_a long, n_b long, both long"
