"""Images as pages: one row a frame, from a column of file contents or from a folder.

A multi-frame TIFF is one file with many pages. Its directories are walked without touching the pixels, so a page cap
and filters on page numbers decide what is decoded at all; each wanted frame is then decoded by itself.
"""

from __future__ import annotations

import glob
import io
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from foliant.operators.crops import png
from foliant.sources.files import IMAGE, PUSHDOWN

#: Tags of a TIFF directory, the sizes of its field types, and its ways of compression.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, COLOURS, TILES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320, 322
FIELD = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WHITE_IS_ZERO, BLACK_IS_ZERO, RGB, PALETTE = 0, 1, 2, 3

#: Frames of more pixels than this fail instead of being decoded, and so do files with more directories.
MOST_PIXELS, MOST_FRAMES = 100_000_000, 1_000_000
#: Bytes of pictures that leave a task together, a single one apart.
BATCH = 16 << 20
FRAME = "page_no int, pages int, width int, height int, channels int, failed boolean, reason string, content binary"
ARROW = [pa.string(), *[pa.int32()] * 5, pa.bool_(), pa.string(), pa.binary()]
COLUMNS = ["page_no", "pages", "width", "height", "channels", "failed", "reason", "content"]


class Broken(Exception):
    """A frame or a file that can't be read; its text is the reason."""


# Directories of a TIFF


class Tiff:
    """The directories of an open file; nothing but them is read until a frame's pixels are asked for."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        head = self.at(0, 8)
        self.order = {b"II*\0": "<", b"MM\0*": ">"}.get(head[:4])
        if self.order is None:
            raise Broken("not a tiff")
        self.first = struct.unpack(f"{self.order}I", head[4:])[0]

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        found = self.file.read(size)
        if len(found) < size:
            raise Broken("truncated")
        return found

    def directories(self) -> Iterator[int]:
        """Where each frame's directory begins. A chain that returns to an earlier one, or leaves the file, ends there."""
        seen, offset = set(), self.first
        while offset and offset not in seen and len(seen) < MOST_FRAMES:
            seen.add(offset)
            try:
                entries = struct.unpack(f"{self.order}H", self.at(offset, 2))[0]
                after = struct.unpack(f"{self.order}I", self.at(offset + 2 + 12 * entries, 4))[0]
            except Broken:
                return
            yield offset
            offset = after

    def tags(self, offset: int) -> dict[int, tuple[int, ...]]:
        entries = struct.unpack(f"{self.order}H", self.at(offset, 2))[0]
        raw, out = self.at(offset + 2, 12 * entries), {}
        for k in range(entries):
            tag, kind, count = struct.unpack_from(f"{self.order}HHI", raw, 12 * k)
            if kind not in FIELD or count > 4 * MOST_FRAMES:
                continue
            code, size = FIELD[kind]
            value = raw[12 * k + 8 : 12 * k + 12]
            if count * size > 4:
                value = self.at(struct.unpack(f"{self.order}I", value)[0], count * size)
            if code != "c":
                out[tag] = struct.unpack_from(f"{self.order}{count}{code}", value)
        return out

    def pixels(self, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
        """A frame as rows of grey or BGR pixels of eight bits."""
        one = lambda tag, default: tags.get(tag, (default,))[0]
        width, height = one(WIDTH, 0), one(HEIGHT, 0)
        samples, bits, kind, way = one(SAMPLES, 1), one(BITS, 1), one(PHOTOMETRIC, BLACK_IS_ZERO), one(COMPRESSION, PLAIN)
        if not 0 < width * height <= MOST_PIXELS:
            raise Broken("no pixels" if width * height <= 0 else "too large")
        if TILES in tags or bits not in (1, 8, 16) or len(set(tags.get(BITS, (1,)))) > 1 or one(PLANAR, 1) != 1 or samples > 8:
            raise Broken("unsupported layout")
        per_row = (width * samples * bits + 7) // 8
        rows, out = min(height, one(ROWS, height)) or height, []
        for k, (offset, count) in enumerate(zip(tags.get(OFFSETS, ()), tags.get(COUNTS, ()), strict=False)):
            want = per_row * min(rows, height - k * rows)
            if want <= 0:
                break
            out.append(unpacked(self.at(offset, count), way, want))
        raw = np.frombuffer(b"".join(out), dtype=np.uint8)
        if len(raw) < per_row * height:
            raise Broken("truncated")
        raw = raw[: per_row * height].reshape(height, per_row)
        if bits == 1:
            page = np.unpackbits(raw, axis=1)[:, : width * samples].reshape(height, width, samples) * np.uint8(255 if kind != PALETTE else 1)
        elif bits == 16:
            page = (raw.view(f"{self.order}u2").reshape(height, width, samples) >> 8).astype(np.uint8)
        else:
            page = raw.reshape(height, width, samples)
        if one(PREDICTOR, 1) == 2:
            if bits != 8:
                raise Broken("unsupported layout")
            page = np.cumsum(page, axis=1, dtype=np.uint8)
        if kind == PALETTE:
            table = (np.array(tags.get(COLOURS, ()), dtype=np.uint16) >> 8).astype(np.uint8)
            if len(table) != 3 << bits or bits == 16:
                raise Broken("unsupported layout")
            return np.ascontiguousarray(table.reshape(3, -1).T[page[:, :, 0]][:, :, ::-1])
        if kind == RGB and samples >= 3:
            return np.ascontiguousarray(page[:, :, 2::-1])
        if kind not in (WHITE_IS_ZERO, BLACK_IS_ZERO):
            raise Broken("unsupported layout")
        return 255 - page[:, :, 0] if kind == WHITE_IS_ZERO else np.ascontiguousarray(page[:, :, 0])


def unpacked(data: bytes, way: int, size: int) -> bytes:
    """A strip's bytes, `size` at most: what claims to hold more is cut, so a small file can't fill the memory."""
    if way == PLAIN:
        return data[:size]
    if way in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise Broken("broken strip") from e
    if way == PACKBITS:
        out, i = bytearray(), 0
        while i < len(data) and len(out) < size:
            n = data[i]
            if n < 128:
                out += data[i + 1 : i + 2 + n]
                i += n + 2
            else:
                out += data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
                i += 2 if n > 128 else 1
        return bytes(out[:size])
    if way == LZW:
        return lzw(data, size)
    raise Broken("unsupported compression")


def lzw(data: bytes, size: int) -> bytes:
    """Variable-length codes, high bits first; 256 clears the table and 257 ends."""
    start = [bytes([b]) for b in range(256)] + [b"", b""]
    table, before, out = start.copy(), b"", bytearray()
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        wide = max(9, min(12, (len(table) + 1 if before else len(table)).bit_length()))
        if bits < wide:
            continue
        bits -= wide
        code = held >> bits & ((1 << wide) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, before = start.copy(), b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise Broken("broken strip")
        now = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + now[:1])
        out += now
        before = now
    return bytes(out[:size])


# Files as pages


def single_size(head: bytes) -> tuple[int, int]:
    """Width and height of a PNG, BMP, GIF, JPEG or WebP by its first bytes; (0, 0) if they can't be told."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:2] == b"BM" and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        return width, abs(height)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        if head[12:16] == b"VP8 ":
            return tuple(x & 0x3FFF for x in struct.unpack("<HH", head[26:30]))
        if head[12:16] == b"VP8L":
            packed = struct.unpack("<I", head[21:25])[0]
            return (packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1
        if head[12:16] == b"VP8X":
            return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
    if head[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(head) and head[i] == 0xFF:
            if 0xC0 <= head[i + 1] <= 0xCF and head[i + 1] not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", head[i + 5 : i + 9])
                return width, height
            i += 2 + struct.unpack(">H", head[i + 2 : i + 4])[0]
    return 0, 0


def failed_page(page_no: int, pages: int, reason: str) -> tuple:
    return page_no, pages, None, None, None, True, reason, None


def frames_of(file: BinaryIO, first: int = 1, last: int | None = None) -> Iterator[tuple]:
    """COLUMNS of the frames first to last (all if None) of an open image; frames outside aren't decoded.

    A frame that can't be decoded is a failed page and the others stay; a file that is no image is one failed page.
    Formats of one frame keep their own bytes as content; a TIFF's frames are PNG files.
    """
    head = file.read(1 << 16)
    if head[:4] not in (b"II*\0", b"MM\0*"):
        if first > 1 or (last is not None and last < 1):
            return
        width, height = single_size(head)
        if width <= 0 or height <= 0:
            yield failed_page(1, 1, "not an image")
        elif width * height > MOST_PIXELS:
            yield failed_page(1, 1, "too large")
        else:
            yield 1, 1, width, height, None, False, None, head + file.read()
        return
    try:
        tiff = Tiff(file)
    except Broken as e:
        yield failed_page(1, 1, str(e))
        return
    found = list(tiff.directories())
    if not found and first == 1:
        yield failed_page(1, 1, "no frame")
    for number, offset in enumerate(found, 1):
        if number < first or (last is not None and number > last):
            continue
        try:
            page = tiff.pixels(tiff.tags(offset))
        except (Broken, struct.error) as e:
            yield failed_page(number, len(found), str(e) if isinstance(e, Broken) else "broken directory")
            continue
        yield number, len(found), page.shape[1], page.shape[0], 1 if page.ndim == 2 else page.shape[2], False, None, png(page)


def frames(files: DataFrame, most: int | None = None) -> DataFrame:
    """files (path, content) as (path, page_no, pages, width, height, channels, failed, reason, content): a row a frame.

    `most` caps the pages of a file as `page_limit` does: at least one, and what lies beyond isn't decoded. `pages`
    counts all of the file's frames. A null content is a failed page. A task holds one file and BATCH bytes of frames.
    """
    cap = None if most is None else max(1, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                file = content.as_buffer()
                for row in frames_of(pa.BufferReader(file), 1, cap) if file is not None else [failed_page(1, 1, "not an image")]:
                    rows.append((path.as_py(), *row))
                    size += len(row[-1] or b"")
                    if size > BATCH or len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), ARROW, strict=True)], ["path", *COLUMNS])
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), ARROW, strict=True)], ["path", *COLUMNS])

    return files.select("path", "content").mapInArrow(run, f"path string, {FRAME}")


class Span(InputPartition):
    """Frames first to last of one file, or whole files."""

    def __init__(self, paths: list[str], first: int = 1, last: int | None = None) -> None:
        self.paths, self.first, self.last = paths, first, last


class PageImages(DataSource):
    """`spark.read.format("page_images").load(folder)`: a row for each frame of each image below a folder.

    Options: path (a folder or a file on a file system that driver and executors mount), pages (the page cap),
    partition_bytes (64 MB by default), pushdown (true where the session pushes filters into Python; `load` sees to it).
    Small files share a partition; a TIFF of more bytes is split by frames. With pushdown, comparisons of page_no with a
    constant and equality of path reach the reader: other frames are not decoded, and other files not opened.
    """

    @classmethod
    def name(cls) -> str:
        return "page_images"

    def schema(self) -> str:
        return f"path string, {FRAME}"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        kind = FilteredPageReader if self.options.get("pushdown") == "true" else PageReader
        return kind(self.options["path"], self.options.get("pages"), int(self.options.get("partition_bytes", 64 << 20)))


class PageReader(DataSourceReader):
    def __init__(self, root: str, pages: str | None, partition_bytes: int) -> None:
        self.root, self.partition_bytes = root.removeprefix("file://"), partition_bytes
        self.first, self.last, self.only = 1, None if pages is None else max(1, int(pages)), None

    def partitions(self) -> list[InputPartition]:
        """Sizes decide: only a file over partition_bytes has its directories walked here, and no pixel is read."""
        every = [self.root] if os.path.isfile(self.root) else sorted(glob.glob(os.path.join(glob.escape(self.root), "**", "*"), recursive=True))
        named = [p for p in every if p.lower().endswith(IMAGE) and os.path.isfile(p) and self.only in (None, p)]
        out, small, held = [], [], 0
        if self.last is not None and self.last < self.first:
            return [Span([])]
        for path in named:
            size = os.path.getsize(path)
            if size > self.partition_bytes and path.lower().endswith((".tif", ".tiff")):
                out += self.split(path, size)
                continue
            if small and held + size > self.partition_bytes:
                out.append(Span(small, self.first, self.last))
                small, held = [], 0
            small.append(path)
            held += size
        if small or not out:
            out.append(Span(small, self.first, self.last))
        return out

    def split(self, path: str, size: int) -> list[Span]:
        try:
            with open(path, "rb") as f:
                count = sum(1 for _ in Tiff(f).directories())
        except Broken:
            return [Span([path], self.first, self.last)]
        last = count if self.last is None else min(count, self.last)
        step = max(1, count * self.partition_bytes // size)
        return [Span([path], a, min(last, a + step - 1)) for a in range(self.first, last + 1, step)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                for row in frames_of(f, partition.first, partition.last):
                    yield (path, *row)


class FilteredPageReader(PageReader):
    """With filters; Spark refuses such a reader in a session that doesn't push filters into Python."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        """Takes what narrows the range of pages or names the file, and gives back the rest."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("page_no",) and isinstance(f, (LessThanOrEqual, LessThan, EqualTo)) and f.value is not None:
                bound = f.value - isinstance(f, LessThan)
                self.last = bound if self.last is None else min(self.last, bound)
                if isinstance(f, EqualTo):
                    self.first = max(self.first, bound)
            elif column == ("page_no",) and isinstance(f, (GreaterThanOrEqual, GreaterThan)) and f.value is not None:
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif column == ("path",) and isinstance(f, EqualTo) and f.value is not None and self.only in (None, f.value):
                self.only = f.value
            elif not (isinstance(f, IsNotNull) and column in (("page_no",), ("path",))):  # these are never null
                yield f


def load(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """The frames of all images below a folder, with filters pushed into the reader; see PageImages for the options."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(PageImages)
    return spark.read.format("page_images").options(pushdown="true", **options).load(folder)


# Writing


def tiff(pages: Iterable[np.ndarray], way: int = DEFLATE) -> bytes:
    """A TIFF of one frame a page (rows of grey or BGR pixels of eight bits), plain or deflated."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        height, width, samples = (*page.shape, 1)[:3]
        raw = np.ascontiguousarray(page if page.ndim == 2 else page[:, :, ::-1]).tobytes()
        data = raw if way == PLAIN else zlib.compress(raw, 1)
        tags = [(WIDTH, width), (HEIGHT, height), (BITS, 8), (COMPRESSION, way), (PHOTOMETRIC, RGB if samples == 3 else BLACK_IS_ZERO), (OFFSETS, len(out)), (SAMPLES, samples), (ROWS, height), (COUNTS, len(data))]
        out += data + b"\0" * (len(data) % 2)
        struct.pack_into("<I", out, link, len(out))
        if samples == 3:  # three depths don't fit into an entry
            out_of_line = len(out) + 2 + 12 * len(tags) + 4
            entries = [struct.pack("<HHII", t, 3, 3, out_of_line) if t == BITS else struct.pack("<HHII", t, 4, 1, v) for t, v in tags]
        else:
            entries = [struct.pack("<HHII", t, 4, 1, v) for t, v in tags]
        out += struct.pack("<H", len(tags)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0" + (struct.pack("<HHH", 8, 8, 8) if samples == 3 else b"")
    return bytes(out)
