from __future__ import annotations

import io
import json
import pickle
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.sources import files, framed_log, images, mcap, media, tables, video
from strandline.sources.path import extract_path, scan_paths


def test_path_scan(spark, tmp_path):
    for name in ("car1/d1/front.mp4", "car1/d2/back.mp4", "car1/notes.txt", "car2/_x/.front.mp4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).touch()
    (tmp_path / "link").symlink_to(tmp_path / "car1")
    got = scan_paths(spark, str(tmp_path), r"^(?P<car_no>[^/]+)/(?P<drive>[^/]+)/\.?(?P<cam>\w+)\.mp4$", {"drive": None, "car_no": "string", "cam": None})
    assert got.columns == ["drive", "car_no", "cam"]
    assert sorted(map(tuple, got.collect())) == [("_x", "car2", "front"), ("d1", "car1", "front"), ("d2", "car1", "back")]
    with pytest.raises(ValueError):
        extract_path(got, r"(?P<a>x)", {"b": None})


def frame(kind, payload):
    return struct.pack("=II", kind, len(payload)) + payload


def test_framed_log(spark, tmp_path):
    head = struct.pack("=III", 12, 1, 8)
    (tmp_path / "a.log").write_bytes(head + frame(4, b"one") + frame(0, b"gps") + frame(99, b"?") + frame(4, b"two") + struct.pack("=II", 7, 50) + b"cut")
    got = framed_log.scan_frames(spark, str(tmp_path), ["ImageMetadata", "VehicleMotion"])
    assert sorted((r.seq, r.message_type, bytes(r.payload)) for r in got.collect()) == [(0, "ImageMetadata", b"one"), (3, "ImageMetadata", b"two"), (4, "VehicleMotion", b"cut")]
    with pytest.raises(ValueError):
        framed_log.scan_frames(spark, str(tmp_path), ["Nothing"])
    for bad in (struct.pack("=III", 13, 1, 8), struct.pack("=III", 12, 2, 8), struct.pack("=III", 12, 1, 9), b""):
        with pytest.raises(ValueError):
            list(framed_log.frames(bad))
    with pytest.warns(UserWarning):
        assert len(list(framed_log.frames(head + frame(0, b"x") + b"\1\2"))) == 1


def descriptors():
    from google.protobuf import descriptor_pb2

    file = descriptor_pb2.FileDescriptorProto(name="m.proto", package="t", syntax="proto3")
    inner = file.message_type.add(name="Vec")
    inner.field.add(name="x", number=1, type=1, label=1)
    outer = file.message_type.add(name="Odom")
    outer.field.add(name="vel", number=1, type=11, label=1, type_name=".t.Vec")
    outer.field.add(name="n", number=2, type=4, label=1)
    return descriptor_pb2.FileDescriptorSet(file=[file]).SerializeToString()


def test_framed_log_messages(spark, tmp_path):
    from strandline.sources.protobuf import message_class

    kind = message_class(descriptors(), "t.Odom")
    payload = kind(vel={"x": 2.5}, n=7).SerializeToString()
    (tmp_path / "a.log").write_bytes(struct.pack("=III", 12, 1, 8) + frame(7, payload))
    got = framed_log.decode(framed_log.scan_frames(spark, str(tmp_path)), {"VehicleMotion": {"n": "int"}}, descriptors(), {"VehicleMotion": "t.Odom"})
    assert got["VehicleMotion"].select("seq", "n").first() == (0, 7)


def text(s):
    return struct.pack("<I", len(s)) + s.encode()


def record(op, body):
    return struct.pack("<BQ", op, len(body)) + body


def mcap_file(messages, compression="zstd", summary=True):
    import zstandard

    blob = lambda b: struct.pack("<I", len(b)) + b
    schemas = record(3, struct.pack("<H", 1) + text("S") + text("jsonschema") + blob(b"{}")) + record(3, struct.pack("<H", 2) + text("t.Odom") + text("protobuf") + blob(descriptors()))
    channels = record(4, struct.pack("<HH", 1, 1) + text("/a") + text("json") + blob(b"")) + record(4, struct.pack("<HH", 2, 2) + text("/odom") + text("protobuf") + blob(b""))
    inner = schemas + channels + b"".join(record(5, struct.pack("<HIQQ", c, i, t, t + 1) + d) for i, (c, t, d) in enumerate(messages))
    packed = zstandard.ZstdCompressor().compress(inner) if compression == "zstd" else inner
    chunk = record(6, struct.pack("<QQQI", 0, 9, len(inner), zlib.crc32(inner)) + text(compression) + struct.pack("<Q", len(packed)) + packed)
    out = mcap.MAGIC + record(1, text("") + text(""))
    at = len(out)
    out += chunk + record(15, struct.pack("<I", 0))
    start = len(out)
    index = struct.pack("<QQQQ", 0, 9, at, len(chunk)) + struct.pack("<I", 20) + struct.pack("<HQHQ", 1, 0, 2, 0) + struct.pack("<Q", 0) + text(compression) + struct.pack("<QQ", len(packed), len(inner))
    out += schemas + channels + record(8, index)
    return out + record(2, struct.pack("<QQI", start if summary else 0, 0, 0)) + mcap.MAGIC


@pytest.mark.parametrize("compression", ["zstd", ""])
def test_mcap(spark, tmp_path, compression):
    from strandline.sources.protobuf import message_class

    odom = message_class(descriptors(), "t.Odom")(vel={"x": 1.5}, n=3).SerializeToString()
    sent = [(1, 20, b'{"p": 2}'), (1, 10, b'{"p": 1, "q": "z"}'), (2, 15, odom)]
    (tmp_path / "a.mcap").write_bytes(mcap_file(sent, compression))
    scanned = mcap.scan_messages(spark, str(tmp_path))
    got = mcap.decode_topics(scanned, {"/a": {"log_time": None, "p": "int"}, "/odom": {"vel.x": None, "publish_time": "bigint"}, "/none": {"p": "int"}})
    assert list(got) == ["/a", "/odom"] and got["/a"].columns == ["input_id", "seq", "p", "log_time"]
    assert [tuple(r)[1:] for r in got["/a"].orderBy("seq").collect()] == [(0, 1, 10), (1, 2, 20)]
    assert tuple(got["/odom"].first())[1:] == (0, 1.5, 16)
    with pytest.warns(UserWarning):
        assert list(mcap.messages(mcap_file(sent), {"/none"})) == []
    with pytest.raises(ValueError, match="summary"):
        list(mcap.messages(mcap_file(sent, summary=False), None))


def indexed_mcap(groups, compression="zstd", chunked=True, indexes=True):
    """A file with a chunk for each group of (channel, time, data) messages, message indexes and statistics."""
    import zstandard

    blob = lambda b: struct.pack("<I", len(b)) + b
    head = record(3, struct.pack("<H", 1) + text("S") + text("jsonschema") + blob(b"{}"))
    head += b"".join(record(4, struct.pack("<HH", c, 1) + text(t) + text("json") + blob(b"")) for c, t in ((1, "/a"), (2, "/b")))
    out, summary, counts = mcap.MAGIC + record(1, text("") + text("")), head, {1: 0, 2: 0}
    for group in groups:
        inner, places = b"", {}
        for c, t, d in group:
            places.setdefault(c, []).append((t, len(inner)))
            counts[c] += 1
            inner += record(5, struct.pack("<HIQQ", c, 0, t, t + 1) + d)
        if not chunked:
            out += inner
            continue
        packed = zstandard.ZstdCompressor().compress(inner) if compression == "zstd" else inner
        chunk = record(6, struct.pack("<QQQI", 0, 9, len(inner), zlib.crc32(inner)) + text(compression) + struct.pack("<Q", len(packed)) + packed)
        at = len(out)
        behind = b"".join(record(7, struct.pack("<H", c) + blob(b"".join(struct.pack("<QQ", *x) for x in xs))) for c, xs in places.items()) if indexes else b""
        out += chunk + behind
        summary += record(8, struct.pack("<QQQQ", 0, 9, at, len(chunk)) + blob(b"".join(struct.pack("<HQ", c, 0) for c in places)) + struct.pack("<Q", len(behind)) + text(compression) + struct.pack("<QQ", len(packed), len(inner)))
    out += record(15, struct.pack("<I", 0))
    start = len(out)
    summary += record(11, struct.pack("<QHIIIIQQ", sum(counts.values()), 1, 2, 0, 0, len(groups), 0, 9) + blob(b"".join(struct.pack("<HQ", *x) for x in counts.items())))
    return out + summary + record(2, struct.pack("<QQI", start, 0, 0)) + mcap.MAGIC


GROUPS = [[(1, 30, b"a30"), (2, 10, b"b10"), (1, 10, b"a10")], [(2, 5, b"b5")], [(1, 20, b"a20"), (1, 10, b"a10 again")]]


@pytest.mark.parametrize(("chunked", "indexes"), [(True, True), (True, False), (False, False)])
def test_mcap_ordinals_across_chunks(spark, tmp_path, chunked, indexes):
    for name in ("x", "y"):
        (tmp_path / f"{name}.mcap").write_bytes(indexed_mcap(GROUPS, "zstd" if name == "x" else "", chunked, indexes))
    got = mcap.scan_messages(spark, str(tmp_path), ["/a"]).orderBy("input_id", "seq").collect()
    assert [(r.input_id[-6], r.seq, r.log_time, bytes(r.data)) for r in got] == [(n, *x) for n in "xy" for x in ((0, 10, b"a10"), (1, 10, b"a10 again"), (2, 20, b"a20"), (3, 30, b"a30"))]
    counts = {(r.input_id[-6], r.topic): r.messages for r in mcap.message_counts(spark, str(tmp_path)).collect()}
    assert counts == {(n, t): k for n in "xy" for t, k in (("/a", 4), ("/b", 2))}
    index = mcap.message_index(spark, str(tmp_path), ["/b"])
    assert sorted((r.input_id[-6], r.seq, r.log_time) for r in index.collect()) == [(n, *x) for n in "xy" for x in ((0, 5), (1, 10))]
    wanted = spark.createDataFrame([(f"file:{tmp_path}/x.mcap", "/a", 3), (f"file:{tmp_path}/x.mcap", "/a", 3), (f"file:{tmp_path}/y.mcap", "/b", 0), (f"file:{tmp_path}/y.mcap", "/b", 7)], "input_id string, topic string, seq long")
    few = mcap.fetch_messages(spark, str(tmp_path), wanted.withColumn("input_id", F.col("input_id"))).collect()
    assert sorted((r.topic, r.seq, bytes(r.data)) for r in few) == [("/a", 3, b"a30"), ("/b", 0, b"b5")]


def test_mcap_of_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "x.mcap").write_bytes(indexed_mcap(GROUPS))
    monkeypatch.setattr(files, "SEEKABLE", frozenset())
    monkeypatch.setattr(mcap, "SEEKABLE", frozenset())
    listed = files.scan_files(spark, str(tmp_path)).first()
    assert bytes(listed.content) == indexed_mcap(GROUPS) and listed.length == len(listed.content)
    assert mcap.scan_messages(spark, str(tmp_path)).count() == 6


def test_mcap_topic_of_several_schemas(spark):
    from google.protobuf.descriptor_pb2 import FileDescriptorSet

    from strandline.sources.protobuf import message_class

    other = FileDescriptorSet.FromString(descriptors())
    for message in other.file[0].message_type:
        for field in message.field:
            if field.name == "n":
                field.number = 9
    other = other.SerializeToString()
    sent = [("a", "protobuf", "t.Odom", "protobuf", d, message_class(d, "t.Odom")(n=n).SerializeToString()) for n, d in ((3, descriptors()), (4, other))]
    sent.append(("c", "json", "S", "jsonschema", b"{}", b'{"n": 5}'))
    rows = [(f"{i}{k}", "/odom", 0, 10, 11, *rest) for k, (i, *rest) in enumerate(sent)]
    scanned = spark.createDataFrame(rows, "input_id string, topic string, seq long, log_time long, publish_time long, encoding string, schema_name string, schema_encoding string, schema_data binary, data binary")
    got = mcap.decode_topics(scanned, {"/odom": {"n": "int", "log_time": None}})
    assert sorted(map(tuple, got["/odom"].collect())) == [("a0", 0, 3, 10), ("a1", 0, 4, 10), ("c2", 0, 5, 10)]


def test_media(spark, tmp_path):
    points = np.zeros(3, [("x", "f4"), ("y", "f4"), ("i", "u1")])
    points["x"] = [1, 2, 3]
    held = io.BytesIO()
    np.save(held, points)
    (tmp_path / "p.npy").write_bytes(held.getvalue())
    got = media.decode_files(media.read_files(spark, str(tmp_path)), media.npy_decoder(["x", "y"])).first()
    assert got["shape"] == [3, 2] and got["values"] == [1, 0, 2, 0, 3, 0]
    names = spark.range(1).select(media.path_from_template("img/{:04d}.jpg", F.lit(7), "int"), media.path_from_template("{:%Y-%m-%dT%H:%M:%S.%f}.npy", F.lit("2024-01-02 03:04:05.5").cast("timestamp_ntz"), "time"))
    assert tuple(names.first()) == ("img/0007.jpg", "2024-01-02T03:04:05.500000.npy")
    with pytest.raises(ImportError):
        media.scan_hdf5(spark, media.read_files(spark, str(tmp_path)), {"a": None})


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_video_header(spark, tmp_path):
    def track(kind, n):
        return box(b"trak", box(b"mdia", box(b"hdlr", bytes(8) + kind + bytes(12)), box(b"minf", box(b"stbl", box(b"stsz", struct.pack(">III", 0, 0, n))))))

    (tmp_path / "v.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"moov", track(b"soun", 9), track(b"vide", 4)))
    got = media.scan_video(media.read_files(spark, str(tmp_path)), "int")
    assert sorted(r.frame_idx for r in got.collect()) == [0, 1, 2, 3]
    with pytest.raises(RuntimeError):
        media.frame_count(box(b"moov"))


def full_box(kind, *numbers, head=0):
    return box(kind, struct.pack(">I", head), b"".join(n if isinstance(n, bytes) else struct.pack(">I", n) for n in numbers))


def movie(samples, codec=b"png ", keys=None, per_chunk=2, setup=b"", extra=b""):
    """An MP4 of one video track whose samples lie before the header, ``per_chunk`` in a chunk with a byte between."""
    body, places = b"", []
    for i in range(0, len(samples), per_chunk):
        places.append(16 + len(body))
        body += b"".join(samples[i : i + per_chunk]) + b"!"
    entry = box(codec, setup)
    tables = [full_box(b"stsd", 1, entry), full_box(b"stsz", 0, len(samples), *map(len, samples)), full_box(b"stsc", 1, 1, per_chunk, 1), full_box(b"stco", len(places), *places)]
    if keys is not None:
        tables.append(full_box(b"stss", len(keys), *(k + 1 for k in keys)))
    track = box(b"trak", full_box(b"tkhd", 0, 0, 7), box(b"mdia", box(b"hdlr", bytes(8) + b"vide" + bytes(12)), box(b"minf", box(b"stbl", *tables))))
    return box(b"ftyp", b"isom    "[:0]) + box(b"mdat", body) + box(b"moov", track, extra)


def test_frames_from_key_frames(spark, tmp_path):
    read = []

    def decoder(codec, setup, samples):
        """A frame is the sum of the samples since the key frame."""
        read.append(len(samples))
        assert codec == "summ" and setup == b"xyz"
        total, out = 0, []
        for s in samples:
            total += s[0]
            out.append(np.array([[total]], np.int16))
        return out

    film = movie([bytes([i]) * (i + 1) for i in range(10)], b"summ", [0, 4, 8], 3, b"xyz")
    track = video.read_track(io.BytesIO(film))
    assert len(track) == 10 and track.run(7) == (4, 7) and [film[a] for a in track.offsets] == list(range(10))
    got = {i: int(f[0, 0]) for i, f in video.read_frames(io.BytesIO(film), track, [1, 5, 6, 9], decoder)}
    assert got == {1: 1, 5: 9, 6: 15, 9: 17} and read == [2, 3, 2]
    with pytest.raises(IndexError):
        track.run(10)
    (tmp_path / "v.mp4").write_bytes(film)
    path = media.read_files(spark, str(tmp_path)).first().path
    wanted = spark.createDataFrame([(path, i) for i in (9, 5, 5, None)], "input_id string, frame_idx long")

    def plain(codec, setup, samples):
        return [np.full((2, 2, 1), sum(x[0] for x in samples[: i + 1]), np.uint8) for i in range(len(samples))]

    rows = video.decode_frames(media.read_files(spark, str(tmp_path)), wanted, plain, [images.resize(3, 4), images.channels_first]).collect()
    assert sorted((r.frame_idx, r.shape, set(bytes(r.data))) for r in rows) == [(5, [1, 3, 4], {9}), (9, [1, 3, 4], {17})]


def test_fragmented_video():
    header = movie([], extra=box(b"mvex", full_box(b"trex", 7, 1, 0, 3, 0x10000)))
    parts, out = [b"abc", b"de", b"fgh"], header
    # two samples of their own sizes, the first one a key frame; then one of the default size and flags
    sizes = full_box(b"trun", 2, 64, 0, 3, 2, head=0x205)
    out += box(b"moof", box(b"traf", full_box(b"tfhd", 7), full_box(b"trun", 2, 8 + 8 + 16 + len(sizes) + 8, 0, 3, 2, head=0x205))) + box(b"mdat", parts[0] + parts[1])
    out += box(b"moof", box(b"traf", full_box(b"tfhd", 8), full_box(b"trun", 1, head=0)), box(b"traf", full_box(b"tfhd", 7), full_box(b"trun", 1, 8 + 8 + 16 + 16 + 8 + 16 + 20 + 8, head=1))) + box(b"mdat", parts[2])
    track = video.read_track(io.BytesIO(out))
    assert track.sizes.tolist() == [3, 2, 3] and [out[a : a + n] for a, n in zip(track.offsets, track.sizes)] == parts
    assert track.keys.tolist()[0] == 0 and video.frame_count(out) == 3


def png(pixels, bits=8, colour=2, filters=(0, 1, 2, 3, 4), palette=None):
    """An image with the given filter for each line in turn."""
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    h, w = pixels.shape[:2]
    if bits < 8:
        flat = np.unpackbits(pixels.reshape(h, w, 1).astype(np.uint8), axis=2)[:, :, 8 - bits :].reshape(h, -1)
        lines = np.packbits(flat, axis=1)
    else:
        lines = np.frombuffer(pixels.astype(">u2" if bits == 16 else "u1").tobytes(), np.uint8).reshape(h, -1)
    step = max(1, (1 if pixels.ndim == 2 else pixels.shape[2]) * bits // 8)
    raw, above = b"", np.zeros(lines.shape[1], int)
    for y, line in enumerate(lines.astype(int)):
        kind = filters[y % len(filters)]
        left = np.concatenate([np.zeros(step, int), line])[: len(line)]
        corner = np.concatenate([np.zeros(step, int), above])[: len(line)]
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        guess = {0: 0 * line, 1: left, 2: above, 3: (left + above) // 2, 4: np.choose(d.argmin(axis=0), [left, above, corner])}[kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    parts = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0))
    if palette is not None:
        parts += chunk(b"PLTE", np.asarray(palette, np.uint8).tobytes()) + chunk(b"tRNS", b"\x07")
    return b"\x89PNG\r\n\x1a\n" + parts + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images():
    rng = np.random.default_rng(3)
    for colour, samples in ((0, 1), (2, 3), (4, 2), (6, 4)):
        for bits in (8, 16):
            want = rng.integers(0, 1 << bits, (11, 7, samples))
            assert (images.decode_image(png(want, bits, colour)) == want).all()
    small = rng.integers(0, 4, (5, 9))
    assert (images.decode_image(png(small, 2, 0))[:, :, 0] == small * 85).all()
    palette = rng.integers(0, 256, (4, 3))
    got = images.decode_image(png(small, 2, 3, palette=palette))
    assert (got[:, :, :3] == palette[small]).all() and (got[:, :, 3] == np.where(small == 0, 7, 255)).all()
    grey = rng.integers(0, 256, (3, 5), np.uint8)
    assert (images.decode_image(b"P5 # note\n5 3\n255\n" + grey.tobytes())[:, :, 0] == grey).all()
    with pytest.raises(ValueError):
        images.decode_image(png(small, 2, 0)[:-20] + b"x" * 20)
    assert images.resize(6, 10, smooth=False)(grey).shape == (6, 10) and (images.resize(3, 5)(grey) == grey).all()
    ramp = np.tile(np.arange(8.0), (2, 1))
    assert np.allclose(images.resize(2, 4)(ramp), [[0.5, 2.5, 4.5, 6.5]] * 2)


def test_files_by_path_without_listing(spark, tmp_path):
    for i in (3, 4, 9):
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / f"{i:04d}.pgm").write_bytes(b"P5 2 1 255\n" + bytes([i, i + 1]))
    samples = spark.createDataFrame([(0, "a", [3, 9, 3]), (1, "a", [5])], "sample_idx long, input_id string, i array<int>")
    table = media.path_media(samples, str(tmp_path), "{:04d}.pgm", "i", images.decode_image, dtype="int", missing="null")
    got = {r.sample_idx: [v and v["values"] for v in r.m] for r in media.lookup(samples, table, "i", "m").collect()}
    assert got == {0: [[3, 4], [9, 10], [3, 4]], 1: [None]}
    with pytest.raises(Exception, match="No such file"):
        media.path_media(samples, str(tmp_path), "{:04d}.pgm", "i", images.decode_image).collect()


def test_hdf5_trees_and_rows(spark, tmp_path):
    """With a stand-in for h5py, which isn't installed: a pickled dictionary of paths."""
    held = {"/data/demo_0/x": np.arange(5.0), "/data/demo_0/obs/pos": np.arange(10.0).reshape(5, 2), "/data/demo_0/obs/short": np.arange(3.0), "/data/demo_0/obs": {}}
    (tmp_path / "f.hdf5").write_bytes(pickle.dumps(held))

    def opener(raw):
        import pickle
        from contextlib import nullcontext

        return nullcontext(pickle.loads(raw.read()))

    listed = media.read_files(spark, str(tmp_path))
    tree = media.scan_hdf5(spark, listed, {"x": None, "obs": {"pos": "array<double>", "short": None, "none": "int"}}, "/data/demo_0", opener)
    assert list(tree) == ["", "obs"] and [r.x for r in tree[""].orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    rows = tree["obs"].orderBy("seq").collect()
    assert [r.pos for r in rows] == [[2.0 * i, 2.0 * i + 1] for i in range(5)] and [r.none for r in rows] == [None] * 5 and rows[4].seq == 4
    with pytest.raises(Exception, match="is a group"):
        media.scan_hdf5(spark, listed, {"obs": None}, "/data/demo_0", opener).collect()
    path = listed.first().path
    wanted = spark.createDataFrame([(path, 4), (path, 1), (path, 4)], "input_id string, seq long")
    got = media.hdf5_rows(listed, wanted, "/data/demo_0/obs/pos", opener=opener).orderBy("seq").collect()
    assert [(r.seq, r.data.shape, r.data["values"]) for r in got] == [(1, [2], [2, 3]), (4, [2], [8, 9])]


def test_lookup_keeps_places(spark):
    samples = spark.createDataFrame([(0, "a", [2, 9, 2]), (1, "a", [])], "sample_idx long, input_id string, i array<long>")
    table = spark.createDataFrame([("a", 2, "two"), ("b", 9, "nine")], "input_id string, seq long, data string")
    got = {r.sample_idx: r.m for r in media.lookup(samples, table, "i", "m").collect()}
    assert got[0] == ["two", None, "two"]


def test_json(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"speed": 1.5, "pos": {"x": 1}}, {"speed": 2.5, "pos": {"x": 2}}]}))
    got = tables.scan_json_records(spark, str(tmp_path / "r.json"))
    assert [(r.seq, r.speed, r.x) for r in got.orderBy("seq").collect()] == [(0, 1.5, 1), (1, 2.5, 2)]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"t": 5}, "geometry": {"type": "Point", "coordinates": [9.0, 50.0]}}]}))
    got = tables.scan_geojson(spark, str(tmp_path / "g.json")).first()
    assert got["t"] == 5 and tuple(got["geom"]) == (9.0, 50.0)
