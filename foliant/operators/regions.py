"""Bands and regions of a page found in its pixels.

Python turns a page into slabs, runs of ink that repeat from row to row, and no more. What hangs together is then found
by Spark, for all pages at once: slabs that touch are joined, and the components of that relation are labelled, a
batch of pages at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.model import BOX
from foliant.operators import figures, raster
from foliant.operators.crops import spread
from foliant.sources.scratch import written

#: The margins left out of a page, what counts as an empty row, how far apart rows of one gap may lie, and the
#: smallest gap and band, in rows.
MARGIN, EMPTY, EMPTY_SHARE, GAP_JOIN, GAP_LEAST, BAND_LEAST = 0.04, 0.002, 0.2, 6, 8, 40
#: Sides of the rectangles that close and grow ink, as shares of the page's shorter side; then the
#: smallest region's share and side, and what overlap or nearness makes two regions one.
CLOSE, GROW, REGION_SHARE, REGION_SIDE, REGION_IOU, REGION_GAP, REGIONS = 0.008, 0.015, 0.015, 40, 0.20, 0.01, 8
#: The part of a band's foot that holds its caption, the least that is kept, the closing rectangle, the
#: smallest and the longest figure, and what height, place and width are worth beside the area.
FOOT, KEPT, BAND_CLOSE, FIGURE_SHARE, FIGURE_LONGEST, SMALLEST_BAND = 0.22, 0.55, 0.01, 0.08, 12.0, 30
HEIGHT_WORTH, TOP_WORTH, WIDTH_WORTH, WIDTH_MOST = 200.0, 50.0, 20.0, 0.9
#: Columns of a page that one key of the join of touching slabs stands for.
TILE = 64
#: Links that a task labels at once, a single page's apart.
LINKS = 2_000_000


# Bands


def quantile(values: Column, share: float) -> Column:
    """The value at a share of an array in order, between its neighbours in proportion."""

    def between(s: Column) -> Column:
        at = share * (F.size(s) - 1)
        low = F.floor(at).cast("int")
        a, t = F.get(s, low), at - low
        b = F.coalesce(F.get(s, low + 1), a)
        return F.when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (1 - t))

    return let(F.sort_array(values), between)


def gaps(rows: Column) -> Column:
    """The middles of runs of an ascending array: neighbours at most GAP_JOIN apart are one run; short runs are left out."""

    def middles(r: Column) -> Column:
        opens = F.filter(r, lambda y, i: (i == 0) | (y - F.get(r, i - 1) > GAP_JOIN))
        closes = F.filter(r, lambda y, i: (i == F.size(r) - 1) | (F.get(r, i + 1) - y > GAP_JOIN))
        spans = F.zip_with(opens, closes, lambda a, b: F.when(b - a >= GAP_LEAST, F.floor((a + b) / 2).cast("int")))
        return F.filter(spans, lambda m: m.isNotNull())

    return let(rows, middles)


def spaced(cuts: Column, most: Column) -> Column:
    """At most so many entries of an array, evenly spaced over it."""
    last = F.size(cuts) - 1
    step = F.when(most > 1, last / (most - 1)).otherwise(0.0)
    picked = F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(1)) - 1), lambda k: F.get(cuts, F.bround(k * step).cast("int")))
    return F.when(F.size(cuts) > most, picked).otherwise(cuts)


def figure_bands(density: Column, captions: Column) -> Column:
    """array<struct<y0, y1>>: a page cut along empty rows into as many bands as it has captions, at most.

    density: the share of ink in each row (`raster.density`). A page with one caption, or without a gap of its own,
    is one band within its margins; null or no rows: no band.
    """
    kind = "array<struct<y0:int,y1:int>>"
    span = lambda a, b: F.struct(a.alias("y0"), b.alias("y1"))

    def empty_rows(inside: Column, top: Column) -> Column:
        bar = F.greatest(F.lit(EMPTY), quantile(inside, EMPTY_SHARE))
        low = lambda t: F.transform(inside, lambda v, i: F.when(v <= t, i + top))
        return F.filter(let(bar, low), lambda y: y.isNotNull())

    def cut(d: Column, top: Column, bottom: Column) -> Column:
        rows = let(F.slice(d, top + 1, bottom - top), lambda inside: empty_rows(inside, top))
        cuts = F.sort_array(F.array_distinct(let(gaps(rows), lambda m: spaced(m, captions - 1))))

        def step(s: Column, y: Column) -> Column:
            after = F.struct(y.alias("at"), F.array_append(s["out"], span(s["at"], y)).alias("out"))
            return F.when(y - s["at"] > BAND_LEAST, after).otherwise(s)

        start = F.struct(top.alias("at"), F.array().cast(kind).alias("out"))
        bands = F.aggregate(cuts, start, step, lambda s: F.when(bottom - s["at"] > BAND_LEAST, F.array_append(s["out"], span(s["at"], bottom))).otherwise(s["out"]))
        return let(bands, lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(span(top, bottom))))

    def body(d: Column) -> Column:
        top = F.floor(F.size(d) * MARGIN).cast("int")
        edges = F.struct(top.alias("top"), (F.size(d) - top).alias("bottom"))
        whole = lambda e: F.array(span(e["top"], e["bottom"]))
        return let(edges, lambda e: F.when(F.coalesce(captions, F.lit(0)) <= 1, whole(e)).otherwise(cut(d, e["top"], e["bottom"])))

    none = F.array().cast(kind)
    return let(density, lambda d: F.when(F.coalesce(F.size(d), F.lit(0)) <= 0, none).otherwise(body(d))).cast(kind)


# Runs of ink


def closed(ink: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return ~spread(~spread(ink, kx, ky), kx, ky)


def region_ink(page: np.ndarray) -> np.ndarray:
    """Where a page has ink, gaps closed and all grown, so that lines and letters of one block hang together."""
    side = min(page.shape)
    a, b = max(3, int(side * CLOSE)), max(3, int(side * GROW))
    return spread(closed(page < raster.INK, a, a), b, b)


def band_ink(page: np.ndarray) -> np.ndarray:
    """Where a band without its foot has ink, gaps closed."""
    return closed(page < raster.INK, max(3, int(page.shape[1] * BAND_CLOSE)), max(3, int(page.shape[0] * BAND_CLOSE)))


def slabs(ink: np.ndarray) -> np.ndarray:
    """Rows (x0, y0, x1, y1): the runs of set pixels in each row, equal runs of consecutive rows as one."""
    edge = np.diff(np.pad(ink, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1]
    order = np.lexsort((y, x1, x0))
    y, x0, x1 = y[order], x0[order], x1[order]
    first = np.flatnonzero((np.diff(x0, prepend=-1) != 0) | (np.diff(x1, prepend=-1) != 0) | (np.diff(y, prepend=-2) != 1))
    last = np.append(first[1:], len(y)) - 1 if len(first) else first
    return np.stack([x0[first], y[first], x1[first], y[last] + 1], axis=1)


def ink_slabs(pages: DataFrame, find: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """pages (page_id, image, y0, y1) as (page_id, slab, x0, y0, x1, y1): slabs() of find()'s ink in the rows from y0 to y1.

    slab numbers are unique within a page. A page whose image can't be read, or an empty range, has none. A task holds
    one page's picture at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, height, width, channels, data, y0, y1 = (batch.column(i)[row].as_py() for i in range(7))
                if page_id is None or data is None or (height or 0) <= 0 or y1 <= y0:
                    continue
                own = slabs(find(raster.gray(height, width, channels, data)[y0:y1])) + (0, y0, 0, y0)
                found.append(np.column_stack([np.full(len(own), page_id), own]))
                if sum(map(len, found[-64:])) > 1 << 16 or len(found) >= 4096:
                    yield rows(found)
                    found = []
        if found:
            yield rows(found)

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        page_id, x0, y0, x1, y1 = np.concatenate(found).T
        arrays = [pa.array(page_id, pa.int64()), pa.array(y0 << 32 | x0, pa.int64()), *(pa.array(v.astype(np.int32)) for v in (x0, y0, x1, y1))]  # one run begins at a pixel
        return pa.RecordBatch.from_arrays(arrays, ["page_id", "slab", "x0", "y0", "x1", "y1"])

    fields = [F.col("page_id").cast("long"), *(F.col(f"image.{f}") for f in ("height", "width", "nChannels", "data")), F.col("y0").cast("int"), F.col("y1").cast("int")]
    return pages.select(*fields).mapInArrow(run, "page_id long, slab long, x0 int, y0 int, x1 int, y1 int")


# What hangs together


def touching(found: DataFrame) -> DataFrame:
    """(page_id, a, b): slabs of which one begins in the row where the other has ended, and whose columns or corners meet.

    Slabs that share a row are apart, as they are runs of it. Keys hold TILE columns, so a crowded row isn't one key.
    """
    tiles = lambda df: df.withColumn("tile", F.explode(F.sequence(F.floor(F.col("x0") / TILE), F.floor(F.col("x1") / TILE))))
    above = tiles(found).select("page_id", "tile", F.col("y1").alias("y"), F.col("slab").alias("a"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"))
    below = tiles(found).select("page_id", "tile", F.col("y0").alias("y"), F.col("slab").alias("b"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    met = above.join(below, ["page_id", "tile", "y"]).where("ax0 <= bx1 AND bx0 <= ax1")
    # A pair that meets in several tiles is kept in the one where the later of both begins.
    return met.where(f"tile = floor(greatest(ax0, bx0) / {TILE})").select("page_id", "a", "b")


def reachable(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to count - 1 the smallest node that it reaches by the links a[i] - b[i].

    All links at once: the higher of two roots is hung below the lower, then every node is led to its root.
    """
    root = np.arange(count)
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high != low
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != root[root]).any():
            root = root[root]


def components(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, node, component) for every node of `edges` (graph, a, b: long): the smallest node that it reaches.

    For many small graphs: one shuffle brings a graph's links together, and a task labels a batch of graphs at once,
    as one graph of parts that don't meet. A graph must fit into a task, as a page does.
    """

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        links = batch.column(1)
        flat = links.flatten()
        a, b = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        own = np.repeat(np.arange(batch.num_rows), links.value_lengths().to_numpy(zero_copy_only=False))
        graphs, nodes = np.tile(own, 2), np.concatenate([a, b])
        order = np.lexsort((nodes, graphs))
        graphs, nodes = graphs[order], nodes[order]
        new = np.concatenate([[True], (graphs[1:] != graphs[:-1]) | (nodes[1:] != nodes[:-1])])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        graphs, nodes = graphs[new], nodes[new]
        root = reachable(len(nodes), number[: len(a)], number[len(a) :])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(graphs)), pa.array(nodes), pa.array(nodes[root])], ["graph", "node", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)) // LINKS
            first = 0
            for end in [*(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]:
                if end > first:
                    yield label(batch.slice(first, end - first))
                first = end

    links = edges.groupBy(graph).agg(F.collect_list(F.struct("a", "b")).alias("links"))
    return links.mapInArrow(run, "graph long, node long, component long").withColumnRenamed("graph", graph)


def ink_boxes(slabs: DataFrame) -> DataFrame:
    """slabs (page_id, slab, x0, y0, x1, y1) as (page_id, x0, y0, x1, y1): boxes around what hangs together, corners included."""
    found = written(slabs, "slabs")
    of = components(touching(found), "page_id").withColumnRenamed("node", "slab")
    own = found.join(of, ["page_id", "slab"], "left").withColumn("component", F.coalesce("component", "slab"))
    around = [F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")]
    boxes = own.groupBy("page_id", "component").agg(*(c.cast("double").alias(n) for c, n in zip(around, ("x0", "y0", "x1", "y1"), strict=True)))
    return boxes.drop("component")


def page_boxes(images: DataFrame, most: int = REGIONS) -> DataFrame:
    """images (page_id, image) as (page_id, k, x0, y0, x1, y1): a page's regions, the largest first, at most so many.

    Small and narrow blocks are left out before near ones are joined. Page ids are unique; a page without a region has no row.
    """
    sized = images.select("page_id", "image", F.lit(0).alias("y0"), F.col("image.height").alias("y1"))
    sizes = images.select("page_id", F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    boxes = ink_boxes(ink_slabs(sized, region_ink)).join(sizes, "page_id")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fine = boxes.where((w * h / (F.col("width") * F.col("height")) >= REGION_SHARE) & (w >= REGION_SIDE) & (h >= REGION_SIDE))
    one = figures.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    pages = fine.groupBy("page_id").agg(F.sort_array(F.collect_list(one)).alias("boxes"), (F.max(F.greatest("width", "height")) * REGION_GAP).alias("gap"))  # a page has room for 1 / REGION_SHARE of them
    merged = figures.merge_page_boxes(pages, REGION_IOU, gap_col="gap").drop("k")
    largest = Window.partitionBy("page_id").orderBy((-w * h), "y0", "x0")
    return merged.withColumn("k", F.row_number().over(largest) - 1).where(F.col("k") < most).select("page_id", "k", "x0", "y0", "x1", "y1")


def main_figures(images: DataFrame) -> DataFrame:
    """images (page_id, image, y0, y1) as (page_id, x0, y0, x1, y1): the figure of each page's band from y0 to y1.

    The band's foot, where its caption stands, is left out; of the blocks that are large enough and no bar of text, the
    one of the highest worth is the figure: area, height and width count for it, distance from the top against it.
    A band without one has no row. Page ids are unique: a page with several bands is given as several pages.
    """
    height = F.col("image.height")
    top = F.greatest(F.lit(0), F.least(F.col("y0"), height - 1))
    banded = images.withColumn("top", top).withColumn("bottom", F.greatest(F.col("top") + 1, F.least(F.col("y1"), height)))
    high = F.col("bottom") - F.col("top")
    kept = F.greatest(F.floor(high * KEPT), F.floor(high * (1.0 - FOOT))).cast("int")
    large = banded.where((high >= SMALLEST_BAND) & (F.col("image.width") >= SMALLEST_BAND))
    sized = large.select("page_id", "image", F.col("top").alias("y0"), (F.col("top") + kept).alias("y1"))
    sizes = sized.select("page_id", F.col("image.width").alias("width"), F.col("y0").alias("top"), (F.col("y1") - F.col("y0")).alias("rows"))
    boxes = ink_boxes(ink_slabs(sized, band_ink)).join(sizes, "page_id")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long = F.greatest(w / F.greatest(h, F.lit(1.0)), h / F.greatest(w, F.lit(1.0)))
    fine = boxes.where((w * h / (F.col("width") * F.col("rows")) >= FIGURE_SHARE) & (w >= REGION_SIDE) & (h >= REGION_SIDE) & (long <= FIGURE_LONGEST))
    worth = w * h + h * HEIGHT_WORTH - (F.col("y0") - F.col("top")) * TOP_WORTH + F.least(w, F.col("width") * WIDTH_MOST) * WIDTH_WORTH
    best = fine.groupBy("page_id").agg(F.max_by(F.struct("x0", "y0", "x1", "y1"), F.struct(worth, -F.col("y0"), -F.col("x0"))).alias("b"))
    return best.select("page_id", F.col("b").cast(BOX).alias("b")).select("page_id", "b.*")
