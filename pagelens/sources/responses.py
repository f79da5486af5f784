"""Raw answers of servers: bytes to text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMED = r"charset=[\"']?([\w\-]+)"


def _text(raw: bytes | None, encoding: str | None, content_type: str | None) -> str | None:
    if raw is None:
        return None
    encoding = (encoding or "").lower()
    bits = 16 + zlib.MAX_WBITS if "gzip" in encoding else -zlib.MAX_WBITS if "deflate" in encoding else None
    if bits is not None:
        try:
            raw = zlib.decompress(raw, bits)
        except zlib.error:
            pass  # the header is wrong, and the bytes stand as they are
    told = re.search(_NAMED, content_type or "", re.I) or re.search(rf"<meta[^>]+{_NAMED}", raw[:4096].decode("latin-1"), re.I)
    try:
        return raw.decode(told[1] if told else "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


#: Rows of a batch that are unpacked at once; batches hold as many rows as the session says, of any length.
ROWS = 128


def in_slices(of: Callable[..., object], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """of(...) for each row of Arrow columns, a few rows at a time, so that only these are Python objects."""
    parts = [pa.array([of(*row) for row in zip(*(c.slice(i, ROWS).to_pylist() for c in columns), strict=True)], kind) for i in range(0, len(columns[0]), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.StringType())
def _decoded(raw: pa.Array, encoding: pa.Array, content_type: pa.Array) -> pa.Array:
    return in_slices(_text, pa.string(), raw, encoding, content_type)


def decoded(raw: Column, encoding: Column, content_type: Column) -> Column:
    """Text of an answer by its headers: unpacked, in the character set of the header, else of the page's head, else UTF-8."""
    return _decoded(raw, encoding, content_type)
