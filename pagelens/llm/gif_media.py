"""GIF media columns: timed frames as shown and their colours, from the bytes of GIF files.

``frames`` reads any GIF: LZW code streams, global and local palettes, interlace, and the rules of transparency and
disposal by which a frame is drawn over what the one before left.  ``file_columns`` does so for a column of files.

``encode`` stores 8-bit samples losslessly, 64 a row, under a grey palette, as pages of up to 64 rows that are shown
one after the other.  Pixels that the canvas already shows are stored as transparent where that is half of a page or
more, and a page's disposal is the one (leave it, go back to what was there before, or clear it) after which the most
pixels of the next page are right.  Pages are LZW-coded; a clear code follows when a table is full.

Cases: a null text is an empty one; a text's bytes are padded with 0 to a positive multiple of 64; rows of equal texts
have equal values; a null doc_id stays one; an empty table gives an empty table; other columns are ignored.  Of files a null, or one that is no
whole GIF, has an error and no frames; bytes behind the end are ignored, and pixels beyond the canvas are not shown.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

UNIT, ROWS, DELAY_CS, STEPS = 64, 64, 10, 8
FULL = 4096
LEAVE, CLEAR, RESTORE = 1, 2, 3
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


@dataclass
class Frame:
    left: int
    top: int
    delay_cs: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    palette: np.ndarray


@lru_cache(maxsize=8)
def _schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offsets and widths of the codes after a clear code, until the table is full; from then on they have 12 bits."""
    number = np.arange(FULL - (1 << bits))
    entries = np.minimum((1 << bits) + 2 + np.maximum(0, number - 1), FULL - 1)
    width = np.maximum(np.ceil(np.log2(entries + 1)).astype(np.int64), bits + 1)
    return np.cumsum(width) - width, width


def lzw_coded(samples: bytes, bits: int = 8) -> bytes:
    """The code stream of samples of ``bits`` bits; the table grows to 4,096 entries and is then begun anew."""
    clear = 1 << bits
    table: dict[int, int] = {}
    codes, sizes, begun = [clear], [1], 1
    add, free = codes.append, clear + 2
    rest = iter(samples)
    run = next(rest, None)
    for s in rest:
        key = run << 8 | s
        if key in table:
            run = table[key]
            continue
        add(run)
        table[key] = free
        free += 1
        run = s
        if free == FULL:
            add(clear)
            sizes.append(len(codes) - begun)
            begun, free = len(codes), clear + 2
            table.clear()
    if run is not None:
        add(run)
    add(clear + 1)
    sizes.append(len(codes) - begun)
    # The first clear code stands before any table.
    widths = np.concatenate([[bits + 1], *(_schedule(bits)[1][:n] for n in sizes[1:])])
    at = np.cumsum(widths) - widths
    shifted = np.array(codes, np.int64) << (at & 7)
    out, first = np.zeros(int(at[-1] + widths[-1] + 7) // 8 + 2, np.uint8), at >> 3
    for k in range(3):
        out += np.bincount(first + k, shifted >> 8 * k & 255, len(out)).astype(np.uint8)
    return out[:-2].tobytes()


def _expanded(codes: np.ndarray, bits: int) -> np.ndarray:
    """Samples of the codes of one table.

    The n-th entry is the text of the n-th code and one more sample, and these stand in a row in the output.  So every
    output byte of an entry is a copy of an earlier one, and pointers to these are doubled until they reach literals.
    """
    parent = codes - ((1 << bits) + 2)
    number = np.arange(len(codes))
    literal = parent < 0
    if (parent >= number).any():
        raise ValueError("a code refers to an entry that is not there yet")
    up, hops = np.where(literal, number, parent), (~literal).astype(np.int64)
    while not literal[up].all():
        hops, up = hops + hops[up], up[up]
    length = hops + 1
    start = np.cumsum(length) - length
    shift = np.where(literal, 0, start - start[np.where(literal, 0, parent)])
    source = np.arange(int(length.sum())) - np.repeat(shift, length)
    fixed = np.repeat(literal, length)
    while not fixed[source].all():
        source = source[source]
    return np.repeat(codes, length)[source].astype(np.uint8)


def lzw(data: bytes, bits: int) -> bytes:
    """Samples of a code stream whose samples have ``bits`` bits; it may go on with a full table before a clear code."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    offset, width = _schedule(bits)
    out: list[bytes] = []
    own: list[np.ndarray] = []  # codes of the table so far
    bit, stop = 0, len(data) * 8
    while bit < stop:
        at, wide = (bit + 12 * np.arange(FULL), np.full(FULL, 12)) if own else (bit + offset, width)
        room = int(np.searchsorted(at + wide, stop, "right"))
        k = at[:room] >> 3
        word = raw[k].astype(np.int64) | raw[k + 1].astype(np.int64) << 8 | raw[k + 2].astype(np.int64) << 16
        codes = word >> (at[:room] & 7) & (1 << wide[:room]) - 1
        marks = np.flatnonzero((codes == clear) | (codes == end))
        cut = int(marks[0]) if len(marks) else room
        own.append(codes[:cut])
        if not len(marks) and room == len(wide):
            bit = int(at[-1] + wide[-1])
            continue
        out.append(_expanded(np.concatenate(own), bits).tobytes())
        own = []
        if not len(marks) or codes[cut] == end:
            break
        bit = int(at[cut] + wide[cut])
    if own:
        out.append(_expanded(np.concatenate(own), bits).tobytes())
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for k in range(0, len(data), 255) if (part := data[k : k + 255])) + b"\0"


def _sub_blocks(data: bytes, i: int) -> tuple[bytes, int]:
    parts = []
    while data[i]:
        parts.append(data[i + 1 : i + 1 + data[i]])
        i += data[i] + 1
    return b"".join(parts), i + 1


def _right(canvas: np.ndarray, page: np.ndarray) -> int:
    return int((canvas[: len(page)] == page).sum())


def encode(samples: np.ndarray, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF of 8-bit samples, 64 a row, a page for every 64 rows."""
    rows = len(samples) // UNIT
    if rows * UNIT != len(samples) or not rows:
        raise ValueError("samples must fill rows of 64")
    parts = [b"GIF89a", struct.pack("<HHBBB", UNIT, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    pages = [samples.reshape(rows, UNIT)[k : k + ROWS] for k in range(0, rows, ROWS)]
    canvas = np.full((min(rows, ROWS), UNIT), -1, np.int16)  # -1: nothing is shown
    for page, after in zip(pages, [*pages[1:], None], strict=True):
        free, stored = None, page
        if len(pages) > 1 and 2 * _right(canvas, page) >= page.size and (unused := np.flatnonzero(np.bincount(page.ravel(), minlength=256) == 0)).size:
            free = int(unused[0])
            stored = np.where(canvas[: len(page)] == page, np.uint8(free), page)
        disposal = LEAVE
        if after is not None:
            kept = canvas.copy()
            kept[: len(page)] = page
            disposal, canvas, right = max(((LEAVE, kept, _right(kept, after)), (RESTORE, canvas, _right(canvas, after))), key=lambda x: x[2])
            if 2 * right < after.size:
                disposal, canvas = CLEAR, kept
                canvas[: len(page)] = -1
        control = struct.pack("<BHBB", disposal << 2 | (free is not None), delay_cs, free or 0, 0)
        parts += [b"\x21\xf9\x04", control, b"\x2c", struct.pack("<HHHHB", 0, 0, UNIT, len(page), 0), b"\x08", _blocks(lzw_coded(stored.tobytes()))]
    return b"".join([*parts, b"\x3b"])


def _stored(data: bytes) -> tuple[int, int, Iterator[Frame]]:
    """Width, height and frames as stored."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, head = struct.unpack_from("<HHB", data, 6)

    def colours(i: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        table = np.zeros((256, 3), np.uint8)
        table[:n] = np.frombuffer(data, np.uint8, 3 * n, i).reshape(n, 3)
        return table, i + 3 * n

    def each() -> Iterator[Frame]:
        i, palette = 13, np.zeros((256, 3), np.uint8)
        if head & 0x80:
            palette, i = colours(i, head)
        delay, disposal, transparent = 0, 0, None
        while data[i] != 0x3B:
            if data[i] == 0x21:
                body, after = _sub_blocks(data, i + 2)
                if data[i + 1] == 0xF9:
                    packed, delay, colour = struct.unpack_from("<BHB", body)
                    disposal, transparent = packed >> 2 & 7, colour if packed & 1 else None
                i = after
            elif data[i] == 0x2C:
                left, top, w, h, flags = struct.unpack_from("<HHHHB", data, i + 1)
                i, own = i + 10, palette
                if flags & 0x80:
                    own, i = colours(i, flags)
                bits = data[i]
                body, i = _sub_blocks(data, i + 1)
                indices = np.frombuffer(lzw(body, bits), np.uint8)[: w * h]
                if len(indices) < w * h:
                    raise ValueError("a frame ends early")
                indices = indices.reshape(h, w)
                if flags & 0x40:
                    order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                    straight = np.empty_like(indices)
                    straight[order] = indices
                    indices = straight
                yield Frame(left, top, delay, disposal, transparent, indices, own)
                delay, disposal, transparent = 0, 0, None
            else:
                raise ValueError(f"unknown block {data[i]}")

    return wide, high, each()


def frames(data: bytes) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame as stored, and the canvas as shown with it: height x width x (red, green, blue, alpha)."""
    wide, high, stored = _stored(data)
    canvas = np.zeros((high, wide, 4), np.uint8)
    for f in stored:
        before = canvas.copy() if f.disposal == RESTORE else None
        h, w = f.indices.shape
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        indices = f.indices[: area.shape[0], : area.shape[1]]
        drawn = np.concatenate([f.palette, np.full((256, 1), 255, np.uint8)], 1)[indices]
        if f.transparent is None:
            area[:] = drawn
        else:
            np.copyto(area, drawn, where=(indices != f.transparent)[:, :, None])
        yield f, canvas.copy()
        if f.disposal == CLEAR:
            area[:] = 0
        elif before is not None:
            canvas = before


def histogram(shown: np.ndarray) -> np.ndarray:
    """Pixels by eight steps of red, then of green and blue; pixels where nothing is shown count nowhere."""
    clear = shown[:, :, 3] == 0
    seen = shown[~clear] if clear.any() else shown.reshape(-1, 4)
    return np.concatenate([np.bincount(seen[:, c] >> 5, minlength=STEPS) for c in range(3)])


def payload(f: Frame, shown: np.ndarray) -> bytes:
    """The samples of a page that ``encode`` stored: what its place shows, where grey levels are samples."""
    h, w = f.indices.shape
    return shown[f.top : f.top + h, f.left : f.left + w, 0].tobytes()


def _told(data: bytes) -> tuple[list[dict], bytes, np.ndarray]:
    """Rows of the frames column, the samples, and the histogram of all frames."""
    rows, body, total = [], [], np.zeros(3 * STEPS, np.int64)
    for f, shown in frames(data):
        counts = histogram(shown)
        total += counts
        body.append(payload(f, shown))
        rows.append({"delay_ms": 10 * f.delay_cs, "disposal": f.disposal, "transparent": f.transparent, "left": f.left, "top": f.top, "width": f.indices.shape[1], "height": f.indices.shape[0], "histogram": counts.tolist()})
    return rows, b"".join(body), total


def _media(with_bytes: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, body, at in tokens.runs(batch.column("text")):
                out: list[tuple] = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    padded = np.zeros(max(UNIT, -(-(b - a) // UNIT) * UNIT), np.uint8)
                    padded[: b - a] = body[a:b]
                    media = encode(padded)
                    told, samples, counts = _told(media)
                    wide, high = struct.unpack_from("<HH", media, 6)
                    feature = f"{wide}x{high};frames={len(told)};ms={sum(f['delay_ms'] for f in told)};hist=" + ",".join(map(str, counts[:STEPS].tolist()))
                    row = (b - a, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                    out.append((*row, media, told) if with_bytes else row)
                n = 9 if with_bytes else 7
                yield pa.record_batch([ids.slice(i, j - i), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES[:n], strict=True))], NAMES[: n + 1])

    return rows


FRAME = [("delay_ms", pa.int64()), ("disposal", pa.int64()), ("transparent", pa.int64()), ("left", pa.int64()), ("top", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("histogram", pa.list_(pa.int64()))]
FRAMES = pa.list_(pa.struct(FRAME))
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), FRAMES]
NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "frames"]
FRAMES_SQL = "array<struct<delay_ms: long, disposal: long, transparent: long, left: long, top: long, width: long, height: long, histogram: array<long>>>"


def media_columns(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """What is stored for each text and what is read back from it; the file and its frames too, if asked for."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.mapInArrow(_media(with_bytes), schema + f", media binary, frames {FRAMES_SQL}" * with_bytes)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, errors = [], []
        for file in batch.column("content").to_pylist():
            try:
                found.append(_told(file or b"")[0])
                errors.append(None)
            except (ValueError, IndexError, struct.error) as e:  # not a whole GIF
                found.append(None)
                errors.append(str(e) or type(e).__name__)
        yield pa.record_batch([batch.column("id"), pa.array(found, FRAMES), pa.array(errors, pa.string())], ["id", "frames", "error"])


def file_columns(files: DataFrame) -> DataFrame:
    """id, frames and error of each file of (id, content)."""
    files = files.select("id", F.col("content").cast("binary").alias("content"))
    return files.mapInArrow(_files, f"id {files.schema['id'].dataType.simpleString()}, frames {FRAMES_SQL}, error string")
