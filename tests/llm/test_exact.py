"""Sharding, suffix dedup, SentencePiece, TIFF and decontamination against plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import regex

from strandline.llm import decontamination, sentencepiece_bpe, sharding, suffix_dedup, tiff_media
from strandline.llm.common import arrow_limits, only
from strandline.llm.sentencepiece_bpe import Encoder, vocabulary_path
from pyspark.sql import functions as F

from .conftest import ODD


def two(df):
    return only(df, doc_id="long", text="string")


def test_shards(spark, frame):
    rows = [(i * 7 % 501, "x" * (i % 90)) for i in range(500)] + ODD
    df = two(frame(rows)).withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))) + 1)
    got = sharding.shard_by_bytes(df, F.col("size"), 16, rows=20).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        by[r.shard].append(r)
    assert [r.position for r in sorted(got, key=lambda r: r.position)] == list(range(len(rows)))
    assert all([r.slot for r in rs] == list(range(len(rs))) for rs in by.values())
    order = [(r.doc_id is not None, r.doc_id or 0) for s in sorted(by) for r in by[s]]
    assert order == sorted(order)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in rs) - total / 16) <= largest for rs in by.values())
    assert sharding.shard_by_bytes(df.limit(0), F.col("size")).count() == 0


@pytest.mark.parametrize("hot", ["one", "null", "apart"])
def test_shards_against_prefix_sums(spark, hot):
    """Shards, slots and places computed anew in plain Python, with an id that most rows share or lack."""
    rng = random.Random(8)
    ids = {"one": [7] * 300 + list(range(100)), "null": [None] * 300 + list(range(100)), "apart": list(range(400))}[hot]
    rows = [(i, rng.randint(1, 5000), "old") for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, size long, shard string").repartition(3)
    got = sorted(sharding.shard_by_bytes(df, F.col("size"), 7, rows=30).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(400)) and sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, n) for i, n, _ in rows)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    total, end, slots = sum(r.size for r in got), 0, collections.Counter()
    for r in got:
        end += r.size
        assert r.shard == min(6, (2 * end - r.size) * 7 // (2 * total)) and r.slot == slots[r.shard]
        slots[r.shard] += 1



def test_suffix_dedup_at_400_bytes_on_a_whole_table(spark):
    """Against a count of every 400-byte string of sf0.01 by its hash."""
    arrow_limits(spark)
    docs = only(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), doc_id="long", text="string")
    rows = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    starts = {d: np.array([hash(b[i : i + 400]) for i in range(len(b) - 399)], np.int64) for d, b in rows.items()}
    values, counts = np.unique(np.concatenate(list(starts.values())), return_counts=True)
    often = values[counts > 1]
    removed = 0
    for r in suffix_dedup.deduplicated(docs, 400).collect():
        raw, hit = rows[r.doc_id], np.isin(starts[r.doc_id], often)
        change = np.zeros(len(raw) + 1, np.int64)
        at = np.flatnonzero(hit)
        np.add.at(change, at, 1)
        np.add.at(change, at + 400, -1)
        gone = np.cumsum(change)[:-1] > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        removed += r.n_removed > 0
    assert removed > 100


def plain_dedup(rows, length):
    count = collections.Counter(b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(suffix_dedup.runs(np.array(gone, bool))), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [2000, 2])
def test_suffix_dedup(spark, frame, many):
    arrow_limits(spark)
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(4)]
    rows = list(ODD)
    for i in range(120):
        t = "".join(rng.choice("abcdefghij kl") for _ in range(rng.randint(0, 120)))
        if i % 2:
            a = rng.randrange(60)
            t = t[:40] + rng.choice(pool)[a : a + rng.randint(10, 60)] + t[40:]
        rows.append((i, t))
    got = suffix_dedup.deduplicated(two(frame(rows)), 20, many).collect()
    assert sorted([(*r[:5], bytes(r[5])) for r in got], key=str) == plain_dedup(rows, 20)
    assert suffix_dedup.deduplicated(two(frame([])), 20).count() == 0


@pytest.mark.parametrize("alphabet", [b"ab", b"a", b"abc ", bytes(range(256))])
def test_suffix_sort(alphabet):
    rng = random.Random(len(alphabet))
    for length in (8, 13, 40):
        pool = bytes(rng.choice(alphabet) for _ in range(3 * length))
        contexts = []
        for _ in range(12):
            c = bytearray(rng.choice(alphabet) for _ in range(length + rng.randint(0, 30)))
            at = rng.randrange(2 * length)
            c[: length + 3] = pool[at : at + length + 3][: len(c)]
            contexts.append(bytes(c[: max(length, len(c))]) + bytes(max(0, length - len(c))))
        zones = [len(c) - length + 1 for c in contexts]
        count = collections.Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
        for c, mask in zip(contexts, suffix_dedup.repeated_starts(contexts, zones, length)):
            assert mask.tolist() == [count[c[i : i + length]] > 1 for i in range(len(c) - length + 1)]


def test_sentencepiece_is_the_library(spark, frame):
    arrow_limits(spark)
    e = Encoder(vocabulary_path())
    library = e.model.library
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", ".", ",", "..", "...", "²", "m²", "(", "_", "__x", "é", "中", "\U0001F600", "'s", "\t", "\r\n", "▁", "\x00", "3.14", "|", "!!", "x" * 300, "<s>", "<0x41>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [t or "" for _, t in ODD]
    for text in texts:
        ids = library.encode(text)
        assert e.encode(text) == ids == e.model.encode(text)
        assert e.model.decode(ids) == library.decode(ids)
    assert e.differing == 0
    for ids in ([3 + 0xC3], [3 + 0xE2, 3 + 0x82], [1, 5, 2, 0x41 + 3]):
        assert e.model.decode(ids).replace(" ⁇ ", "") == library.decode(ids).replace(" ⁇ ", "")
    got = sentencepiece_bpe.digest(two(frame(ODD)), vocabulary_path()).collect()
    want = []
    for d, t in ODD:
        ids = library.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    ids = {r.doc_id: r.ids for r in sentencepiece_bpe.encode_column(two(frame(ODD)), vocabulary_path(), ["doc_id"]).collect()}
    assert ids[901] == [] and ids[905] == library.encode("the same row")


def test_sentencepiece_checks_every_unit():
    e = Encoder(vocabulary_path())
    library = e.model.library
    texts = ["one two three, four.\nfive\n six  seven (eight)\n\n中文中 nine", "ten\t\televen   \n", ".. x", "a" * 300]
    units = {u for t in texts for u in e.units(t)}
    right = e.agenda

    class Wrong:
        id_text, id_bytes = right.id_text, right.id_bytes

        def encode(self, units):
            return [[5] if u.replace("▁", " ") == bad else ids for u, ids in zip(units, right.encode(units))]

    for bad in units:
        e = Encoder(vocabulary_path())
        e.agenda = Wrong()
        for text, (ids, raw) in zip(texts, e.batch(texts)):
            assert [int(i) for i in ids.split(",")] == library.encode(text), bad
            assert raw.decode() == text
        assert e.differing == 1
    e = Encoder(vocabulary_path())
    list(e.batch(texts))
    assert e.differing == 0


@pytest.mark.parametrize("compression", [tiff_media.NONE, tiff_media.LZW, tiff_media.DEFLATE, tiff_media.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    rng = np.random.default_rng(0)
    for tile in (0, 16):
        for order in "<>":
            for kind in (np.uint8, np.uint16, np.uint32):
                pages = [rng.integers(0, 250, (1, 1)).astype(kind), (rng.integers(0, 5, (70, 40, 3)) * 40).astype(kind)]
                back = tiff_media.read_tiff(tiff_media.write_tiff(pages, compression, predictor, tile, order=order))
                assert [p.reshape(p.shape[0], p.shape[1], -1).tolist() for p in pages] == [b.tolist() for b in back]


def test_lzw_and_packbits_are_those_of_the_format():
    # codes 256 7 258 8 8 2 257 in nine bits, high bits first
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 2, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff_media.un_lzw(data, 99) == bytes([7, 7, 7, 8, 8, 2])
    assert tiff_media.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 99) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    long = bytes(np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8)) + b"ab" * 9000
    assert tiff_media.un_lzw(tiff_media.lzw(long), len(long)) == long


def test_tiff_pages(spark, frame):
    arrow_limits(spark)
    media = spark.createDataFrame([(1, tiff_media.write_tiff([np.zeros((3, 4), np.uint8), np.ones((2, 2), np.uint16)])), (2, b"II*\0 nothing"), (3, None)], "id long, content binary")
    got = sorted([(r.id, r.page, r.height, r.width, r.bits, r.error is None) for r in tiff_media.read_pages(media, ["id"]).collect()])
    assert got == [(1, 0, 3, 4, 8, True), (1, 1, 2, 2, 16, True), (2, -1, None, None, None, False), (3, -1, None, None, None, False)]
    rows = {r.doc_id: r for r in tiff_media.round_trip(two(frame(ODD))).collect()}
    for d, t in ODD[3:]:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert tiff_media.round_trip(two(frame([]))).count() == 0


def tiff(pages, order="<"):
    """A file of one-strip pages from (fields, strips); the strips' places and sizes are put in."""
    import struct

    t = tiff_media
    out, link = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0)), 4
    for fields, strips in pages:
        places = []
        for strip in strips:
            places.append(len(out))
            out += strip
        fields = fields | {t.STRIPS: places, t.STRIP_SIZES: [len(s) for s in strips]}
        entries = b""
        for tag in sorted(fields):
            packed = struct.pack(f"{order}{len(fields[tag])}I", *fields[tag])
            if len(packed) > 4:
                packed, place = struct.pack(order + "I", len(out)), packed
                out += place
            entries += struct.pack(order + "HHI", tag, 4, len(fields[tag])) + packed
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("order", "<>")
def test_tiff_layouts(order):
    t = tiff_media
    floats = np.array([[1.5, -2.0, 3.25], [0.0, 1e9, -7.5]], "f4")
    turned = floats.astype(">f4").view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1).reshape(2, 12)
    turned = np.concatenate([turned[:, :1], np.diff(turned, axis=1)], axis=1)
    size = {t.WIDTH: [3], t.HEIGHT: [2]}
    pages = [
        (size, [bytes([0b10100000, 0b01000000])]),
        (size | {t.BITS: [4]}, [bytes([0x12, 0x30, 0xF0, 0x70])]),
        (size | {t.BITS: [8, 8], t.SAMPLES: [2], t.PLANAR: [2]}, [bytes(range(6)), bytes(range(10, 16))]),
        (size | {t.BITS: [32], t.FORMAT: [3]}, [floats.astype(order + "f4").tobytes()]),
        (size | {t.BITS: [32], t.FORMAT: [3], t.PREDICTOR: [3]}, [turned.tobytes()]),
        (size | {t.BITS: [16], t.FORMAT: [2]}, [np.arange(-3, 3, dtype=order + "i2").tobytes()]),
    ]
    got = [p.tolist() for p in t.read_tiff(tiff(pages, order))]
    assert got == [
        [[[1], [0], [1]], [[0], [1], [0]]], [[[1], [2], [3]], [[15], [0], [7]]], [[[0, 10], [1, 11], [2, 12]], [[3, 13], [4, 14], [5, 15]]],
        floats[:, :, None].tolist(), floats[:, :, None].tolist(), [[[-3], [-2], [-1]], [[0], [1], [2]]],
    ]


def test_tiff_keeps_pages_beside_bad_ones(spark):
    arrow_limits(spark)
    size = {tiff_media.WIDTH: [3], tiff_media.HEIGHT: [2], tiff_media.BITS: [8]}
    pages = [(size, [b"abcdef"]), (size, [b"abc"]), (size | {tiff_media.COMPRESSION: [99]}, [b"abcdef"]), (size, [b"ghijkl"])]
    media = spark.createDataFrame([(1, tiff(pages)), (2, tiff(pages[:1])[:-4] + b"\xff\xff\0\0")], "id long, content binary")
    got = sorted((r.id, r.page, r.data and bytes(r.data), r.error is None) for r in tiff_media.read_pages(media, ["id"]).collect())
    assert got == [(1, 0, b"abcdef", True), (1, 1, None, False), (1, 2, None, False), (1, 3, b"ghijkl", True), (2, 0, b"abcdef", True), (2, 1, None, False)]


def test_decontamination(spark, frame):
    rng = random.Random(4)
    words = [f"q{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 20, 45])))) for i in range(12)] + [(20, None), (21, "  "), (5, "another text of one id")]
    items += items[3:4]
    docs = list(ODD)
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if i % 2:
            p = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if p:
                    p[rng.randrange(len(p))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in p]
        docs.append((i, " ".join(w)))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(two(frame(docs)), spark.createDataFrame(items, "item_id long, text string")).collect()}
    split = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    want = {}
    for i, text in set(items):
        own = split(text)
        if not own:
            continue
        k = min(5, len(own))
        bag = lambda w: collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))  # noqa: E731, B023
        theirs = bag(own)
        for d, t in docs:
            w = split(t)
            for s in range(max(1, len(w) - len(own) + 1)):
                a = bag(w[s : s + len(own)])
                v = sum((a & theirs).values()) / sum((a | theirs).values())
                if d is not None and v >= 0.8:
                    want[d, i] = max(v, want.get((d, i), 0))
    assert want and got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert decontamination.contaminated(two(frame([])), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontamination.contaminated(two(frame(docs)), spark.createDataFrame([], "item_id long, text string")).count() == 0
