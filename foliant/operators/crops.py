"""From a page's captions and boxes to the pictures cut out of it: where boxes come from, which are used, and the cutting itself."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let, strip
from foliant.model import BOX
from foliant.operators import figures, matching, raster

#: A layout box of this share of the page is the page; one box of that share means a scanned page.
WHOLE_PAGE, SCANNED = 0.90, 0.82
#: The smallest share, side and longest shape of a region found in pixels; how near regions are one.
REGION_SHARE, REGION_SIDE, REGION_LONGEST, REGION_IOU, REGION_GAP = 0.015, 40, 14.0, 0.18, 0.006
#: What a caption's position adds to the area of a box that lies there.
PLACE_BONUS = (("左", "x < 0.55", 0.8), ("右", "x > 0.45", 0.8), ("上|顶部", "y < 0.60", 0.5), ("下|底部", "y > 0.40", 0.5), ("中", "y > 0.20 AND y < 0.80", 0.2))
SMALLEST = 20
#: Boxes of a page (page index from 0) in the units of its file. Layout models and PDF readers plug in here.
Locator = Callable[[str, bytes, int], Iterable[figures.Box]]


# Boxes and their sources


def located(pages: DataFrame, layout: Locator, embedded: Locator) -> DataFrame:
    """pages (page_id, path, content, page_index, page_width, page_height) with layout and embedded (arrays of boxes).

    Layout boxes that are the page itself are left out. A locator that fails finds nothing.
    """
    kinds = f"array<{BOX}>"

    def found(locate: Locator, path: str, content: bytes, index: int) -> list[figures.Box]:
        try:
            return [tuple(map(float, b)) for b in locate(path, content, index)]
        except Exception:  # noqa: BLE001  whatever a plugged-in reader raises
            return []

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                whole = r.page_width * r.page_height
                own = [b for b in found(layout, r.path, r.content, r.page_index) if whole <= 0 or (b[2] - b[0]) * (b[3] - b[1]) / whole < WHOLE_PAGE]
                rows.append((r.page_id, *([dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in x] for x in (own, found(embedded, r.path, r.content, r.page_index)))))
            yield pd.DataFrame(rows, columns=["page_id", "layout", "embedded"])

    wanted = pages.select("page_id", "path", "content", "page_index", "page_width", "page_height")
    boxes = wanted.mapInPandas(run, f"page_id long, layout {kinds}, embedded {kinds}")
    return pages.join(boxes, "page_id")


def to_pixels(b: Column, page_width: Column, page_height: Column, width: Column, height: Column) -> Column:
    """A box in a page's units as whole pixels of its image; a page without a size is taken as the image."""
    sx, sy = F.when(page_width > 0, width / page_width).otherwise(1.0), F.when(page_height > 0, height / page_height).otherwise(1.0)
    whole = lambda c: c.cast("long").cast("double")  # noqa: E731  towards zero
    return figures.box(whole(b["x0"] * sx), whole(b["y0"] * sy), whole(b["x1"] * sx), whole(b["y1"] * sy))


def padded(b: Column, width: Column, height: Column, share: float = 0.04, least: Column | None = None) -> Column:
    """A box grown on each side by a share of its own size, `least` pixels at least."""
    pad = lambda lo, hi: F.greatest(F.lit(12.0) if least is None else least, F.floor(F.greatest(F.lit(1.0), b[hi] - b[lo]) * share))
    return figures.expanded(b, pad("x0", "x1"), pad("y0", "y1"), width, height)


def is_scan(boxes: Column, width: Column, height: Column) -> Column:
    """Whether a page's one box is most of it."""
    return (F.size(boxes) == 1) & (width > 0) & (height > 0) & F.coalesce(figures.area(F.get(boxes, F.lit(0))) / (width * height) > SCANNED, F.lit(False))


def is_region(b: Column, width: Column, height: Column, share: float = REGION_SHARE) -> Column:
    """Whether a region found in pixels may be a figure: neither small nor a bar of text."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    return (w * h / F.greatest(F.lit(1.0), width * height) >= share) & (w >= REGION_SIDE) & (h >= REGION_SIDE) & (figures.aspect(b, 1.0) <= REGION_LONGEST)


def best_pairs(positions: Column, boxes: Column, width: Column, height: Column) -> Column:
    """array<struct<k, box>>: captions in order take the best box left, by its area and the place that the caption names."""
    kind = f"struct<left:array<{BOX}>,out:array<struct<k:int,box:{BOX}>>>"

    def value(p: Column, b: Column) -> Column:
        c = figures.centre(b)
        place = {"x": c["x"] / F.greatest(width, F.lit(1.0)), "y": c["y"] / F.greatest(height, F.lit(1.0))}
        total = F.lit(1.0)
        for sign, where, bonus in PLACE_BONUS:
            inside = F.lit(True)
            for part in where.split(" AND "):
                axis, relation, bound = part.split()
                inside = inside & (place[axis] < float(bound) if relation == "<" else place[axis] > float(bound))
            total = total + F.when(p.rlike(sign) & inside, bonus).otherwise(0.0)
        return figures.area(b) * total

    def step(s: Column, k: Column) -> Column:
        p = strip(F.coalesce(F.get(positions, k), F.lit("")))
        ranked = F.transform(s["left"], lambda b, i: F.struct(value(p, b).alias("v"), (-i).alias("i"), b.alias("b")))
        best = F.array_max(ranked)
        taken = F.struct(
            F.filter(s["left"], lambda b, i: i != -best["i"]).alias("left"),
            F.array_append(s["out"], F.struct(k.cast("int").alias("k"), best["b"].alias("box"))).alias("out"),
        )
        return F.when(F.size(s["left"]) > 0, taken).otherwise(s).cast(kind)

    start = F.struct(boxes.alias("left"), F.array().alias("out")).cast(kind)
    ks = F.when(F.size(positions) > 0, F.sequence(F.lit(0), F.size(positions) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ks, start, step, lambda s: s["out"])


# Regions in pixels


def spread(mask: np.ndarray, kx: int, ky: int) -> np.ndarray:
    """Dilation by a rectangle: whether any pixel around is set."""
    for axis, k in ((0, ky), (1, kx)):
        sums = np.cumsum(np.pad(mask.astype(np.int32), [(k // 2 + 1, (k - 1) // 2) if a == axis else (0, 0) for a in (0, 1)]), axis=axis)
        mask = np.take(sums, np.arange(k, sums.shape[axis]), axis=axis) > np.take(sums, np.arange(sums.shape[axis] - k), axis=axis)
    return mask


def regions(page: np.ndarray, share: float = REGION_SHARE, most: int = 12, threshold: int = raster.INK) -> list[figures.Box]:
    """Boxes around what hangs together on a page once small gaps are closed, from top to bottom.

    Runs of ink in each row are linked to the runs that they touch in the row above.
    """
    height, width = page.shape
    kx, ky = max(3, int(width * 0.006)) | 1, max(3, int(height * 0.004)) | 1
    ink = ~spread(~spread(page < threshold, kx, ky), kx, ky)
    edge = np.diff(np.pad(ink, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    label = np.arange(len(row))
    first = np.searchsorted(row, np.arange(height + 1))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for y in range(1, height):
        above, own, end = first[y - 1], first[y], first[y + 1]
        while above < first[y] and own < end:
            if lo[own] <= hi[above] and lo[above] <= hi[own]:  # corners touch too
                a, b = root(above), root(own)
                label[max(a, b)] = min(a, b)
            if hi[above] < hi[own]:
                above += 1
            else:
                own += 1
    roots, group = np.unique([root(i) for i in range(len(label))], return_inverse=True)
    boxes = np.tile((np.inf, np.inf, -np.inf, -np.inf), (len(roots), 1))
    np.minimum.at(boxes[:, 0], group, lo)
    np.minimum.at(boxes[:, 1], group, row)
    np.maximum.at(boxes[:, 2], group, hi)
    np.maximum.at(boxes[:, 3], group, row + 1)
    size = boxes[:, 2:] - boxes[:, :2]
    fine = (size.prod(axis=1) / max(1, height * width) >= share) & (size >= REGION_SIDE).all(axis=1)
    fine &= np.maximum(size[:, 0] / np.maximum(size[:, 1], 1), size[:, 1] / np.maximum(size[:, 0], 1)) <= REGION_LONGEST
    found = figures.merged_boxes([tuple(b) for b in boxes[fine].tolist()], REGION_IOU, max(width, height) * REGION_GAP)
    return sorted(found, key=lambda b: (b[1], b[0]))[:most]


def page_regions(image: Column, share: float = REGION_SHARE, most: int = 12) -> Column:
    """regions() of each image."""

    def run(image: pd.DataFrame) -> pd.Series:
        found = [[] if p is None else regions(p, share, most) for p in raster.pages_of(image)]
        return pd.Series([[dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in x] for x in found])

    return F.pandas_udf(run, f"array<{BOX}>")(image)


def image_size(image: Column) -> Column:
    return F.struct(image["width"].alias("width"), image["height"].alias("height"))


# Plans and pictures


def crop_plan(pages: DataFrame, width: float, height: float) -> DataFrame:
    """(page_id, k, x0, y0, x1, y1, source): the part of the page that each caption's picture is cut from.

    pages: page_id, positions (array<string>, one a caption), layout, embedded and regions (arrays of boxes), and the
    page's own page_width and page_height. Boxes of the layout come first, then embedded images; a page with none
    of them, or one that is a single scanned image, goes by its regions, and without any by the parts of the
    page that the positions name. A picture that repeats an earlier one of its page is left out.
    """
    w, h = F.lit(float(width)), F.lit(float(height))
    pw, ph = F.col("page_width"), F.col("page_height")
    given = F.when(F.size("layout") > 0, F.col("layout")).otherwise(F.col("embedded"))
    useful = F.filter(F.coalesce(given, F.array().cast(f"array<{BOX}>")), lambda b: figures.is_figure_box(b, pw, ph))
    merged = figures.merge_page_boxes(pages.select("page_id", useful.alias("boxes"), (F.greatest(pw, ph) * 0.01).alias("gap")), gap_col="gap")
    boxes = merged.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", figures.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("b")))).alias("m"))
    own = pages.join(boxes, "page_id", "left").withColumn("boxes", F.coalesce(F.transform("m", lambda m: m["b"]), F.array().cast(f"array<{BOX}>")))
    own = own.withColumn("by_box", (F.size("boxes") > 0) & ~is_scan(F.col("boxes"), pw, ph))
    least = F.greatest(F.lit(10.0), F.floor(F.least(w, h) * 0.008))
    pixels = F.transform("boxes", lambda b: padded(to_pixels(b, pw, ph, w, h), w, h, 0.03, least))
    paired = own.where("by_box").select("page_id", F.explode(best_pairs(F.col("positions"), pixels, w, h)).alias("p"))
    rest = own.where("NOT by_box")
    seen = matching.match_page_captions(rest.where("size(regions) > 0").select("page_id", "positions", F.col("regions").alias("boxes")), width, height)
    one = F.struct("k", figures.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("box"))
    seen = seen.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("p"))  # one page's captions
    apart = F.aggregate("p", F.slice("p", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: figures.iou(y["box"], x["box"]) > 0.85), kept).otherwise(F.array_append(kept, x)))
    parts = rest.where("size(regions) = 0").select("page_id", F.posexplode(figures.page_modes(F.col("positions"))).alias("k", "mode"))
    parts = parts.select("page_id", F.struct("k", figures.region(F.col("mode"), w, h).cast(BOX).alias("box")).alias("p"))
    every = [(paired, "boxes"), (seen.select("page_id", F.explode(apart).alias("p")), "regions"), (parts, "positions")]
    out = None
    for rows, source in every:
        rows = rows.select("page_id", "p.k", "p.box.*", F.lit(source).alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return out


def clipped(b: Column, width: Column, height: Column) -> Column:
    """A part of the page within it; null if a side has under SMALLEST pixels."""
    x0, y0 = F.greatest(F.lit(0.0), F.least(b["x0"], width - 1)), F.greatest(F.lit(0.0), F.least(b["y0"], height - 1))
    inside = figures.box(x0, y0, F.greatest(x0 + 1, F.least(b["x1"], width)), F.greatest(y0 + 1, F.least(b["y1"], height)))
    return let(inside, lambda c: F.when((c["x1"] - c["x0"] >= SMALLEST) & (c["y1"] - c["y0"] >= SMALLEST), c))


def picture_name(page: Column, number: Column) -> Column:
    """The file name of a page's picture; both count from 1."""
    return F.format_string("page_%04d_fig_%02d.png", page, number)


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of rows of grey or BGR(A) pixels."""
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    channels = pixels.shape[2]
    rows = pixels if channels == 1 else pixels[:, :, [2, 1, 0, *range(3, channels)]]
    raw = b"".join(b"\0" + r.tobytes() for r in rows)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def cut(image: np.ndarray, b: figures.Box, threshold: int = 248, pad: int = 18) -> bytes | None:
    """The PNG of a part of a page, its white margins trimmed; None if it is too small."""
    x0, y0, x1, y1 = (int(v) for v in b)
    part = image[y0:y1, x0:x1]
    if min(part.shape[:2], default=0) < SMALLEST:
        return None
    grey = raster.gray(*part.shape[:2], part.shape[2], np.ascontiguousarray(part).tobytes())
    tx0, ty0, tx1, ty1 = raster.trim_box(grey, threshold, pad)
    part = part[ty0:ty1, tx0:tx1]
    return png(part) if min(part.shape[:2]) >= SMALLEST else None


def pictures(plan: DataFrame, images: DataFrame) -> DataFrame:
    """(page_id, k, name, content) for plan (page_id, page_no, k, x0, y0, x1, y1) and images (page_id, image)."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                i = r["image"]
                page = np.frombuffer(i["data"], dtype=np.uint8).reshape(i["height"], i["width"], i["nChannels"])
                rows.append((r["page_id"], r["k"], r["name"], cut(page, (r["x0"], r["y0"], r["x1"], r["y1"]))))
            yield pd.DataFrame(rows, columns=["page_id", "k", "name", "content"])

    joined = plan.join(images, "page_id")
    inside = clipped(figures.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]), F.col("image.width").cast("double"), F.col("image.height").cast("double"))
    rows = joined.select("page_id", "k", picture_name(F.col("page_no"), F.col("k") + 1).alias("name"), "image", inside.alias("b")).where("b IS NOT NULL")
    rows = rows.select("page_id", "k", "name", "image", "b.*")
    return rows.mapInPandas(run, "page_id long, k int, name string, content binary").where("content IS NOT NULL")
