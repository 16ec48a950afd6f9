import io
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.sources import page_images


def unpng(content):
    """The pixels of a PNG without filters."""
    width, height, _, kind = struct.unpack(">IIBB", content[16:26])
    at, data = 8, b""
    while at < len(content):
        size = struct.unpack(">I", content[at : at + 4])[0]
        if content[at + 4 : at + 8] == b"IDAT":
            data += content[at + 8 : at + 8 + size]
        at += 12 + size
    channels = {0: 1, 2: 3, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, -1)
    assert not rows[:, 0].any()
    page = rows[:, 1:].reshape(height, width, channels)
    return page[:, :, 0] if channels == 1 else page[:, :, 2::-1]


def noise(seed, shape):
    return np.random.default_rng(seed).integers(0, 256, shape, dtype=np.uint8)


PAGES = [noise(1, (7, 9)), noise(2, (3, 5, 3)), noise(3, (1, 1)), noise(4, (40, 2, 3))]


@pytest.mark.parametrize("way", [page_images.PLAIN, page_images.DEFLATE])
def test_frames_round_trip(way):
    rows = list(page_images.frames_of(io.BytesIO(page_images.tiff(PAGES, way))))
    assert [r[:5] for r in rows] == [(k, 4, p.shape[1], p.shape[0], 1 if p.ndim == 2 else 3) for k, p in enumerate(PAGES, 1)]
    for row, page in zip(rows, PAGES):
        assert np.array_equal(unpng(row[7]), page)
    assert [r[0] for r in page_images.frames_of(io.BytesIO(page_images.tiff(PAGES)), 2, 3)] == [2, 3]


def hand_made(order, tags, strips):
    """A TIFF of one frame: tags as (tag, type, values), strips as bytes."""
    out, offsets = bytearray(b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0", []
    for s in strips:
        offsets.append(len(out))
        out += s
    tags = [*tags, (page_images.OFFSETS, 4, offsets), (page_images.COUNTS, 4, [len(s) for s in strips])]
    entries = b""
    for tag, kind, values in tags:
        code = {1: "B", 3: "H", 4: "I"}[kind]
        packed = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(packed) > 4:
            entries += struct.pack(f"{order}HHII", tag, kind, len(values), len(out))
            out += packed
        else:
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    struct.pack_into(f"{order}I", out, 4, len(out))
    return bytes(out + struct.pack(f"{order}H", len(tags)) + entries + b"\0\0\0\0")


def slow_lzw(data):
    """Codes as an encoder writes them: a bit more from the entry 511, 1023 and 2047 on."""
    table = {bytes([b]): b for b in range(256)}
    bits, wide, now = "100000000", 9, b""
    size = 258
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        bits += f"{table[now]:0{wide}b}"
        table[now + bytes([b])] = size
        size += 1
        if size == 4094:
            bits += f"{256:0{wide}b}"
            table, size, wide = {bytes([x]): x for x in range(256)}, 258, 9
        else:
            wide = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        now = bytes([b])
    bits += f"{table[now]:0{wide}b}"
    size += 1
    wide = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    bits += f"{257:0{wide}b}"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("seed", range(4))
def test_lzw_strips(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"abcd" if seed % 2 else bytes(range(256))) for _ in range(20000))
    assert page_images.lzw(slow_lzw(data), len(data)) == data


def test_kinds_of_frames():
    T = page_images
    grey = noise(9, (5, 6))
    half = [grey[:3].tobytes(), grey[3:].tobytes()]
    size = [(T.WIDTH, 3, [6]), (T.HEIGHT, 3, [5])]
    plain = [*size, (T.BITS, 3, [8]), (T.PHOTOMETRIC, 3, [1]), (T.ROWS, 3, [3])]

    def only(content):
        (row,) = T.frames_of(io.BytesIO(content))
        return row

    for order in "<>":
        assert np.array_equal(unpng(only(hand_made(order, plain, half))[7]), grey)
    white = [(t, k, [0] if t == T.PHOTOMETRIC else v) for t, k, v in plain]
    assert np.array_equal(unpng(only(hand_made("<", white, half))[7]), 255 - grey)
    packed = b"".join(bytes([len(r) - 1]) + bytes(r) for r in grey.reshape(-1, 6).tolist())
    assert np.array_equal(unpng(only(hand_made("<", [*plain[:4], (T.COMPRESSION, 3, [T.PACKBITS])], [packed]))[7]), grey)
    runs = bytes([257 - 30, 7])
    assert (unpng(only(hand_made("<", [*plain[:4], (T.COMPRESSION, 3, [T.PACKBITS])], [runs]))[7]) == 7).all()
    steps = np.diff(grey, axis=1, prepend=np.zeros((5, 1), dtype=np.uint8)).astype(np.uint8)
    assert np.array_equal(unpng(only(hand_made(">", [*plain[:4], (T.COMPRESSION, 3, [T.LZW]), (T.PREDICTOR, 3, [2])], [slow_lzw(steps.tobytes())]))[7]), grey)
    bits = np.random.default_rng(3).integers(0, 2, (5, 6), dtype=np.uint8)
    assert np.array_equal(unpng(only(hand_made("<", [*size, (T.PHOTOMETRIC, 3, [1])], [np.packbits(bits, axis=1).tobytes()]))[7]), bits * 255)
    deep = np.random.default_rng(4).integers(0, 65536, (5, 6), dtype=np.uint16)
    assert np.array_equal(unpng(only(hand_made(">", [*size, (T.BITS, 3, [16]), (T.PHOTOMETRIC, 3, [1])], [deep.astype(">u2").tobytes()]))[7]), deep >> 8)
    colours = np.random.default_rng(5).integers(0, 256, (3, 256))
    got = unpng(only(hand_made("<", [*size, (T.BITS, 3, [8]), (T.PHOTOMETRIC, 3, [3]), (T.COLOURS, 3, (colours * 257).ravel().tolist())], [grey.tobytes()]))[7])
    assert np.array_equal(got, np.stack([colours[c][grey] for c in (2, 1, 0)], axis=2))


def test_broken_files_are_failed_pages(monkeypatch):
    T = page_images
    whole = T.tiff(PAGES)
    reason = lambda content: [(r[0], r[5], r[6]) for r in T.frames_of(io.BytesIO(content))]
    assert reason(b"") == [(1, True, "not an image")]
    assert reason(b"II*\0") == [(1, True, "truncated")]
    assert reason(b"II*\0\0\0\0\0") == [(1, True, "no frame")]
    assert reason(b"II*\0\xff\xff\0\0") == [(1, True, "no frame")]
    loop = bytearray(T.tiff(PAGES[:1]))
    loop[-4:] = loop[4:8]
    assert reason(bytes(loop)) == [(1, False, None)]
    first = T.tiff(PAGES[:1], T.PLAIN)
    assert reason(first.replace(struct.pack("<HHII", T.HEIGHT, 4, 1, 7), struct.pack("<HHII", T.HEIGHT, 4, 1, 70))) == [(1, True, "truncated")]
    assert reason(first.replace(struct.pack("<HHII", T.COMPRESSION, 4, 1, 1), struct.pack("<HHII", T.COMPRESSION, 4, 1, 7))) == [(1, True, "unsupported compression")]
    spoilt = bytearray(whole)
    spoilt[8:12] = b"\xff\xff\xff\xff"
    assert [x[1] for x in reason(bytes(spoilt))] == [True, False, False, False]
    monkeypatch.setattr(T, "MOST_PIXELS", 70)
    assert [x[1:] for x in reason(whole)] == [(False, None), (False, None), (False, None), (True, "too large")]


def test_single_images_keep_their_bytes():
    from foliant.operators.crops import png

    own = png(PAGES[1])
    assert list(page_images.frames_of(io.BytesIO(own))) == [(1, 1, 5, 3, None, False, None, own)]
    heads = {
        b"BM" + b"\0" * 16 + struct.pack("<ii", 12, -8): (12, 8),
        b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 33, 44) + b"\0" * 9: (44, 33),
        b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"): (100, 50),
        b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 5 + struct.pack("<I", 19 | 29 << 14) + b"\0" * 8: (20, 30),
        b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 640, 480): (640, 480),
    }
    for head, size in heads.items():
        assert page_images.single_size(head) == size


def test_a_column_of_files(spark):
    rows = [("a.tif", page_images.tiff(PAGES)), ("b.tif", b"junk"), ("c.tif", None), ("d.tif", page_images.tiff(PAGES[:1]))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = page_images.frames(files).collect()
    assert sorted((r.path, r.page_no, r.pages, r.width, r.failed) for r in got) == [("a.tif", 1, 4, 9, False), ("a.tif", 2, 4, 5, False), ("a.tif", 3, 4, 1, False), ("a.tif", 4, 4, 2, False), ("b.tif", 1, 1, None, True), ("c.tif", 1, 1, None, True), ("d.tif", 1, 1, 9, False)]
    assert sorted((r.path, r.page_no, r.pages) for r in page_images.frames(files, 0).collect() if r.path == "a.tif") == [("a.tif", 1, 4)]
    assert page_images.frames(files.limit(0)).count() == 0


def test_the_source_splits_files_and_takes_filters(spark, tmp_path, monkeypatch):
    many = [noise(k, (64, 64)) for k in range(20)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "long.tiff").write_bytes(page_images.tiff(many, page_images.PLAIN))
    (tmp_path / "one.tif").write_bytes(page_images.tiff(PAGES[:1]))
    (tmp_path / "notes.txt").write_bytes(b"no image")
    read = lambda **options: page_images.load(spark, str(tmp_path), partition_bytes=20000, **options)
    every = read()
    assert every.rdd.getNumPartitions() > 4
    assert sorted((r.path.rpartition("/")[2], r.page_no) for r in every.select("path", "page_no").collect()) == [("long.tiff", k) for k in range(1, 21)] + [("one.tif", 1)]
    pictures = {r.page_no: unpng(r.content) for r in every.where(F.col("path").endswith("long.tiff")).collect()}
    assert all(np.array_equal(pictures[k + 1], many[k]) for k in range(20))
    assert {r.page_no for r in read(pages=3).collect()} == {1, 2, 3}
    long = str(tmp_path / "deep" / "long.tiff")
    few = every.where((F.col("page_no") > 4) & (F.col("page_no") <= 6) & (F.col("path") == long))
    assert few.rdd.getNumPartitions() == 1 and sorted(r.page_no for r in few.collect()) == [5, 6]
    assert every.where("page_no = 20").count() == 1 and every.where("page_no < 1").count() == 0

    reader = page_images.FilteredPageReader(str(tmp_path), None, 1)
    left = list(reader.pushFilters([page_images.LessThan(("page_no",), 9), page_images.EqualTo(("width",), 5), page_images.GreaterThanOrEqual(("page_no",), 2)]))
    assert [f.attribute for f in left] == [("width",)] and (reader.first, reader.last) == (2, 8)
    read_pixels = []
    monkeypatch.setattr(page_images.Tiff, "pixels", lambda self, tags: read_pixels.append(tags) or noise(0, (1, 1)))
    assert [r[1] for span in reader.partitions() for r in reader.read(span)] == list(range(2, 9)) and len(read_pixels) == 7
