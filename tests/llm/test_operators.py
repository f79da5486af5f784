"""Operators without SQL against brute force, and every operator on nulls, ties, repeats, extra columns and no rows."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagelens.llm import gif_media, license_scan, secret_scan, token_counts
from pagelens.llm.decontaminate import drop_contaminated, overlap_report
from pagelens.llm.ngram_join import keep_one_of_each_group, link_documents
from pagelens.llm.packing import pack
from pagelens.llm.quality import held_out, score_documents
from pagelens.llm.registry import queries, tokenizer
from pagelens.llm.sharding import assign, hilbert_index
from pagelens.llm.substring_dedup import remove_repeats

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i % 1009}" for i in range(9000))
NOTICE = "Released under the MIT License."
ROWS = [(1, "a b c d e f", "en"), (2, None, None), (3, "", "en"), (4, LONG, "de"), (5, LONG, "de"), (1, "a b c d e f", "en"), (6, f"token = 'abcdefghijkl' é {NOTICE}", "fr"), (None, "no id here", "fr")]
SCHEMA = "doc_id long, text string, rank string"
TEXTS = [t for _, t, _ in ROWS]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"_k": F.lit(1), "shard": F.lit("x"), "n": F.lit(2)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def by_id(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.doc_id].append(r)
    return found


def test_substring_dedup(odd, none):
    got = by_id(remove_repeats(odd))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[4][0].n_removed > 0 or got[4][0].n_words == 18000
    assert (got[5][0].n_words, got[5][0].n_removed, got[5][0].kept_text) == (18000, 18000, "")
    assert (got[2][0].n_words, got[3][0].kept_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert got[None][0].n_removed == 0 and remove_repeats(none).count() == 0


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = score_documents(docs, labels).where(held_out(F.col("doc_id"))).join(labels, "doc_id").select("quality_score", "quality").collect()
    good, bad = ([r.quality_score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8
    few = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert {r.quality_score for r in score_documents(odd, few).collect()} == {1.0}
    assert score_documents(none, few).count() == 0


def test_license_scan(spark, odd, none):
    got = by_id(license_scan.license_report(odd))
    assert got[6][0].licenses == "MIT" and got[4][0].n_licenses == 0 and len(got[1]) == 2
    assert license_scan.license_report(none).count() == 0
    near = " ".join(["filler"] * 37) + " " + license_scan.TEMPLATES[1][1].replace("conditions", "terms") + " tail" * 50
    assert license_scan.license_report(spark.createDataFrame([(1, near)], "doc_id long, text string")).first().licenses == "BSD"
    empty = spark.createDataFrame([], "license string, text string")
    assert license_scan.license_report(odd, empty).count() == len(ROWS)
    with pytest.raises(ValueError):
        license_scan.license_report(odd, spark.createDataFrame([("x", "too short")], "license string, text string"))


def _slow_lzw(samples, bits):
    """The textbook encoder, code by code; a clear code when the table is full."""
    clear, out, value, held = 1 << bits, [], 0, 0

    def put(code, width):
        nonlocal value, held
        value, held = value | code << held, held + width
        while held >= 8:
            out.append(value & 255)
            value, held = value >> 8, held - 8

    table, width, run = {(i,): i for i in range(clear)}, bits + 1, ()
    put(clear, width)
    for s in samples:
        if (*run, s) in table:
            run = (*run, s)
            continue
        put(table[run], width)
        table[(*run, s)] = len(table) + 2
        if len(table) + 1 >= 1 << width:
            width += 1
        if width == 13 or len(table) + 2 >= 4096:
            put(clear, min(width, 12))
            table, width = {(i,): i for i in range(clear)}, bits + 1
        run = (s,)
    put(table[run], width)
    put(clear + 1, width if len(table) + 2 < 1 << width else width + 1)
    return bytes([*out, value & 255])


@pytest.mark.parametrize("bits,n", [(2, 40), (4, 3000), (8, 700), (8, 9000)])
def test_lzw_of_another_encoder(bits, n):
    samples = bytes((np.arange(n) * 7 // 5 % 11 % (1 << bits)).astype(np.uint8))
    assert gif_media.lzw(_slow_lzw(samples, bits), bits)[:n] == samples


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_lzw_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 300, 20_000):
        for top in (1, 3, 1 << bits):
            samples = bytes(rng.integers(0, min(top, 1 << bits), n, np.uint8))
            assert gif_media.lzw(gif_media.lzw_coded(samples, bits), bits) == samples


def test_lzw_deferred_clear():
    """An encoder that goes on with its full table: 20,000 random samples and no clear code but the first."""
    samples = np.random.default_rng(4).integers(0, 256, 20_000, np.uint8).tobytes()
    table, codes, run = {bytes([k]): k for k in range(256)}, [256], b""
    for k in range(len(samples)):
        one = samples[k : k + 1]
        if run + one in table:
            run += one
            continue
        codes.append(table[run])
        if len(table) + 2 < 4096:
            table[run + one] = len(table) + 2
        run = one
    codes += [table[run], 257]
    value = at = 0
    for n, code in enumerate(codes):
        value |= code << at
        at += max(9, min(12, (258 + max(0, n - 2)).bit_length())) if n else 9
    assert gif_media.lzw(value.to_bytes(at // 8 + 1, "little"), 8) == samples
    with pytest.raises(ValueError):
        gif_media.lzw((256 | 400 << 9).to_bytes(4, "little"), 8)


def _gif(frames, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)), size=(4, 2)):
    """A GIF of frames (disposal, transparent, left, top, rows of indices)."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), bytes(sum(palette, ()))]
    for disposal, transparent, left, top, rows in frames:
        body = gif_media.lzw_coded(bytes(sum(rows, [])), 2)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", disposal << 2 | (transparent is not None), 7, transparent or 0, 0), b"\x2c", struct.pack("<HHHHB", left, top, len(rows[0]), len(rows), 0), b"\x02", bytes([len(body)]), body, b"\0"]
    return b"".join([*out, b"\x3b"])


def test_gif_disposal_and_transparency(spark):
    """Red, then two greens over it that leave, clear and restore, each followed by a blue pixel; worked out by hand."""
    red, colours = [[1] * 4, [1] * 4], {(0, 0, 0, 0): ".", (255, 0, 0, 255): "r", (0, 255, 0, 255): "g", (0, 0, 255, 255): "b"}
    for disposal, want in ((0, "rggr rrrb"), (1, "rggr rrrb"), (2, "r..r r..b"), (3, "rrrr rrrb")):
        data = _gif([(1, None, 0, 0, red), (disposal, 0, 1, 0, [[2, 2], [0, 0]]), (1, None, 3, 1, [[3]])])
        shown = [" ".join("".join(colours[tuple(p)] for p in row) for row in canvas.tolist()) for _, canvas in gif_media.frames(data)]
        assert shown == ["rrrr rrrr", "rggr rrrr", want]
    files = spark.createDataFrame([(1, data), (2, data[:40]), (3, None), (4, b"no image at all")], "id int, content binary")
    rows = {r.id: r for r in gif_media.file_columns(files).collect()}
    assert [(f.delay_ms, f.disposal, f.transparent, f.width) for f in rows[1].frames] == [(70, 1, None, 4), (70, 3, 0, 2), (70, 1, None, 1)]
    assert rows[1].frames[1].histogram == [2] + [0] * 6 + [6] + [6] + [0] * 6 + [2] + [8] + [0] * 7 and rows[1].error is None
    assert all(rows[k].frames is None and rows[k].error for k in (2, 3, 4))


def test_gif_pages():
    """Pages that hardly change, that go back to the one before last, and that have nothing in common."""
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 200, 4096, np.uint8) for _ in range(3))
    near = a.copy()
    near[:100] = 201
    samples = np.concatenate([a, near, b, near, c, c[:640]])
    found = list(gif_media.frames(gif_media.encode(samples)))
    assert b"".join(gif_media.payload(*x) for x in found) == samples.tobytes()
    assert [(f.disposal, f.transparent is not None) for f, _ in found] == [(1, False), (2, True), (2, False), (2, False), (1, False), (1, True)]
    found = list(gif_media.frames(gif_media.encode(np.concatenate([a, near, a, a]))))
    assert [(f.disposal, f.transparent is not None) for f, _ in found] == [(1, False), (3, True), (1, True), (1, True)]


def test_gif_round_trip(odd, none):
    got = by_id(gif_media.media_columns(odd))
    for doc, text, _ in ROWS:
        raw = (text or "").encode()
        size = len(raw)
        raw += bytes(max(64, -(-size // 64) * 64) - size)
        row = got[doc][0]
        data = bytes(row.media)
        samples = b"".join(gif_media.payload(*x) for x in gif_media.frames(data))
        assert samples == raw and (row.payload_sha256, row.payload_bytes, row.n_bytes, row.tail_crc32) == (hashlib.sha256(raw).hexdigest(), len(raw), size, zlib.crc32(raw[-64:]))
        assert (row.media_bytes, row.media_sha256) == (len(data), hashlib.sha256(data).hexdigest()) and len(row.frames) == -(-len(raw) // 4096)
        counts = np.bincount(np.frombuffer(raw, np.uint8) >> 5, minlength=8)
        pages = sum(64 * min(64, len(raw) // 64) for _ in row.frames)
        if len(row.frames) == 1:
            assert row.feature == f"64x{len(raw) // 64};frames=1;ms=100;hist=" + ",".join(map(str, counts)) and pages == len(raw)
    assert got[4][0].media_sha256 == got[5][0].media_sha256 and gif_media.media_columns(none).count() == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(10, "A b, c"), (11, None), (12, "..."), (13, LONG)], "item_id long, text string")
    got = by_id(overlap_report(odd, items))
    assert [r.n_hit for r in got[1]] == [3, 3] and got[4][0].n_hit == 18000 and got[2][0].n_words == 0 and not got[None][0].contaminated
    assert {r.doc_id for r in drop_contaminated(odd, items).collect()} == {2, 3, 6, None}
    assert overlap_report(none, items).count() == 0 and overlap_report(odd, items.limit(0)).where("contaminated").count() == 0


def test_packing(spark, odd, none, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path := tokenizer("word_bpe_49k.json"))
    rows = pack(spark.read.parquet(f"{DIR}/documents.parquet"), path).collect()
    for doc, parts in by_id_rows(rows).items():
        ids = [*t.encode(documents[doc], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    full = defaultdict(list)
    for r in rows:
        full[r.sequence_id].append(r)
    for parts in full.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in rows) / (2048 * len(full)) > 0.95
    assert len({(r.sequence_id, r.offset) for r in pack(odd, path).collect()}) >= len(ROWS) and pack(none, path).count() == 0


def by_id_rows(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
    return found


def _base(text):
    found = []
    for order, (kind, regex, group, least) in enumerate([("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(regex, text) if len(m[group]) >= least]
    return ",".join(x for _, _, x in sorted(found))


def test_secrets(spark, odd, none, documents):
    for doc, rows in by_id(queries()["op7_secret_scans"](spark, DIR)).items():
        assert rows[0].base_sha256 == hashlib.sha256(_base(documents[doc]).encode()).hexdigest()
    got = by_id(secret_scan.secret_report(odd))
    assert got[6][0].n_assign == 1 and got[2][0].spans == "" and len(got[1]) == 2
    clean = by_id(secret_scan.redact(odd))
    assert clean[6][0].text == f"<secret>' é {NOTICE}" and clean[4][0].text == LONG and clean[6][0].shard == "x"
    assert secret_scan.redact(none).count() == 0


def test_token_counts(spark, odd, none, documents):
    t = token_counts.loaded(path := tokenizer("byte_bpe_50k.json"))
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    for doc, rows in by_id(queries()["op8_token_counts"](spark, DIR)).items():
        assert rows[0].n_tokens == count(documents[doc])
    for text in (LONG, "x" * 3000, "a  b\n\n c\t" * 400, "é" * 500 + " 1234567 " * 200, "<|endoftext|> a" * 300):
        assert token_counts.spliced_count(t, text, 256, 16) == count(text)
    assert by_id(token_counts.count_tokens(odd, path))[2][0].n_tokens == 0 and token_counts.count_tokens(none, path).count() == 0


def test_ngram_join(odd, none):
    got = by_id(link_documents(odd))
    assert got[5][0].component_id == 4 and got[3][0].n_shingles == 0 and got[1][0].component_id == 1 and got[2][0].component_id == 2
    kept = [r.doc_id for r in keep_one_of_each_group(odd).collect()]
    assert sorted(x for x in kept if x) == [1, 2, 3, 4, 6] and None in kept
    assert link_documents(none).count() == 0


def test_near_duplicates_stage(spark):
    """A pair with a 5-word Jaccard of 86 / 106 = 0.81 and a 4-word one of 89 / 105 < 0.85, and one with 81 / 111 = 0.73."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"{x}{w}" if i in at else f"{x[:1]}{w}" for i, w in enumerate(words)) for x, at in (("aa", ()), ("ab", (30, 60)), ("b", ()), ("bb", (20, 50, 80)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()) == [0, 2, 3]


def test_sharding(spark, odd, none):
    rows = queries()["op10_sharding"](spark, DIR).collect()
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    sizes = [len(shards[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len(assign(odd).collect()) == len(ROWS) and assign(none).count() == 0
    place = {hilbert_index((a, b, c), 2): (a, b, c) for a in range(4) for b in range(4) for c in range(4)}
    assert sorted(place) == list(range(64))
    assert all(sum(abs(x - y) for x, y in zip(place[i], place[i + 1], strict=True)) == 1 for i in range(63))
