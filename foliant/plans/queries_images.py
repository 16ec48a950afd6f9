"""Queries over images and workbooks: frames, bands, regions, sheets. The files are made of the tables at hand."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import regions
from foliant.plans.inputs import derived, for_duckdb
from foliant.sources import files, page_images

#: Pages of an image file that are read at most.
CAP = 4


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as an image file: one frame to five, grey and coloured ones by turns; every eleventh file is cut short."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for key, size in zip(f["key"], f["size"], strict=True):
                pages = [np.full((10 + key % 7 + k, 20 + size, *(3,) * (k % 2)), 255 - 10 * k, dtype=np.uint8) for k in range(1 + size % 5)]
                made.append(page_images.tiff(pages, page_images.DEFLATE if key % 2 else page_images.PLAIN)[: 6 if key % 11 == 0 else None])
            yield pd.DataFrame({"path": f["key"].astype(str) + ".tif", "content": made})

    return derived(spark, sf_dir, "SELECT p_partkey AS key, p_size AS size FROM <part>").mapInPandas(run, "path string, content binary")


def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a frame, up to the page cap, with the size that the frame's own picture gives."""
    found = page_images.frames(_files(spark, sf_dir), CAP)
    side = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")  # noqa: E731  the head of a PNG
    return found.select("path", "page_no", "pages", "width", "height", "channels", "failed", "reason", side(17).alias("png_width"), side(21).alias("png_height"))


IMAGE_PAGES = f"""
SELECT p_partkey || '.tif' AS path, CAST(k + 1 AS INT) AS page_no, CAST(1 + p_size % 5 AS INT) AS pages, CAST(20 + p_size AS INT) AS width, CAST(10 + p_partkey % 7 + k AS INT) AS height,
  CAST(CASE WHEN k % 2 = 1 THEN 3 ELSE 1 END AS INT) AS channels, false AS failed, CAST(NULL AS VARCHAR) AS reason, CAST(20 + p_size AS INT) AS png_width, CAST(10 + p_partkey % 7 + k AS INT) AS png_height
FROM part, range({CAP}) r(k) WHERE p_partkey % 11 <> 0 AND k < 1 + p_size % 5
UNION ALL SELECT p_partkey || '.tif', 1, 1, NULL, NULL, NULL, true, 'truncated', NULL, NULL FROM part WHERE p_partkey % 11 = 0
"""

#: A part as a page's profile: rows of ink between empty ones, and how many captions the page has.
PROFILES = "SELECT p_partkey AS key, 240 + p_size * 4 AS h, 40 + p_partkey % 30 AS period, 4 + p_partkey % 13 AS gap, CAST(p_partkey % 5 AS INT) AS captions FROM <part>"
_INK = "CASE WHEN y % period < gap THEN ((y + key) % 3) / 1000.0 ELSE (20 + (y * 7 + key) % 50) / 1000.0 END"


def page_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut into bands, one a caption at most."""
    ink = F.expr(f"transform(sequence(0, CAST(h - 1 AS INT)), y -> CAST({_INK} AS DOUBLE))")
    rows = derived(spark, sf_dir, PROFILES).select("key", F.posexplode(regions.figure_bands(ink, F.col("captions"))).alias("k", "b"))
    return rows.select("key", "k", "b.y0", "b.y1")


# Empty rows are numbered into gaps by windows; a recursion takes one cut a step.
PAGE_BANDS = f"""
WITH RECURSIVE p AS (SELECT *, CAST(floor(h * 0.04) AS INT) AS top, h - CAST(floor(h * 0.04) AS INT) AS bottom FROM ({for_duckdb(PROFILES)})),
d AS (SELECT key, y, top, CAST({_INK} AS DOUBLE) AS v FROM (SELECT *, unnest(range(top, bottom)) AS y FROM p)),
bar AS (SELECT key, greatest(0.002, quantile_cont(v, 0.2)) AS bar FROM d GROUP BY key),
low AS (SELECT key, y, coalesce(y - lag(y) OVER (PARTITION BY key ORDER BY y) > 6, true) AS opens FROM d JOIN bar USING (key) WHERE v <= bar),
runs AS (SELECT key, y, sum(opens::INT) OVER (PARTITION BY key ORDER BY y) AS run FROM low),
middles AS (SELECT key, (min(y) + max(y)) // 2 AS m FROM runs GROUP BY key, run HAVING max(y) - min(y) >= 8),
ranked AS (SELECT key, m, row_number() OVER (PARTITION BY key ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM middles),
wanted AS (
  SELECT DISTINCT key, m FROM ranked JOIN p USING (key)
  WHERE captions > 1 AND (n <= captions - 1 OR list_contains(list_transform(range(captions - 1), lambda k: CAST(round_even(k * (CASE WHEN captions > 2 THEN (n - 1)::DOUBLE / (captions - 2) ELSE 0 END), 0) AS BIGINT)), i))),
cuts AS (SELECT key, m, row_number() OVER (PARTITION BY key ORDER BY m) AS c FROM wanted),
fold AS (
  SELECT key, CAST(0 AS BIGINT) AS c, CAST(top AS BIGINT) AS start, CAST([] AS BIGINT[]) AS ends FROM p
  UNION ALL
  SELECT f.key, t.c, CASE WHEN t.m - start > 40 THEN t.m ELSE start END, CASE WHEN t.m - start > 40 THEN list_append(ends, t.m) ELSE ends END FROM fold f JOIN cuts t ON t.key = f.key AND t.c = f.c + 1),
ended AS (SELECT key, arg_max(start, c) AS start, arg_max(ends, c) AS ends FROM fold GROUP BY key),
bands AS (
  SELECT key, list_prepend(top, CASE WHEN len(ends) = 0 OR bottom - start > 40 THEN list_append(ends, bottom) ELSE ends END) AS edges FROM ended JOIN p USING (key))
SELECT key, CAST(k AS INT) AS k, CAST(edges[k + 1] AS INT) AS y0, CAST(edges[k + 2] AS INT) AS y1 FROM (SELECT key, edges, unnest(range(len(edges) - 1)) AS k FROM bands)
"""

#: A customer as a page of 200 by 150 pixels, an order as a black rectangle on a grid of four pixels.
RECTANGLES = """
SELECT o_custkey AS page_id, 4 * (o_orderkey % 38) AS x0, 4 * ((o_orderkey * 7) % 25) AS y0,
       4 * (o_orderkey % 38) + 4 * (1 + o_orderkey % 12) AS x1, 4 * ((o_orderkey * 7) % 25) + 4 * (1 + (o_orderkey * 3) % 11) AS y1
FROM <orders>
"""
WIDTH, HEIGHT = 200, 150


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, image) of the customers' pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = []
            for boxes in batch.column(1).to_pylist():
                page = np.full((HEIGHT, WIDTH), 255, dtype=np.uint8)
                for b in boxes:
                    page[b["y0"] : b["y1"], b["x0"] : b["x1"]] = 0
                pages.append(page.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.binary())], ["page_id", "data"])

    dealt = derived(spark, sf_dir, RECTANGLES).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")  # pictures are larger than orders
    boxes = dealt.groupBy("page_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))  # one page's
    image = F.struct(F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.lit(1).alias("nChannels"), "data")
    return boxes.mapInArrow(run, "page_id long, data binary").select("page_id", image.alias("image"))


def visual_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions that pages show, the largest first."""
    return regions.page_boxes(drawn(spark, sf_dir))


def main_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main figure between rows 10 and 140 of each page."""
    return regions.main_figures(drawn(spark, sf_dir).withColumns({"y0": F.lit(10), "y1": F.lit(140)}))


def _hanging(rectangles: str) -> str:
    """What hangs together as SQL: rectangles that meet, over any number of others; (page_id, c, x0, y0, x1, y1)."""
    return f"""
r AS MATERIALIZED (SELECT page_id, x0, y0, x1, y1, row_number() OVER (PARTITION BY page_id ORDER BY x0, y0, x1, y1) AS n FROM (SELECT DISTINCT * FROM ({rectangles}))),
meet AS MATERIALIZED (SELECT a.page_id, a.n AS a, b.n AS b FROM r a JOIN r b ON a.page_id = b.page_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
reach AS (SELECT page_id, a, b FROM meet UNION SELECT reach.page_id, reach.a, meet.b FROM reach JOIN meet ON meet.page_id = reach.page_id AND meet.a = reach.b),
part_of AS (SELECT page_id, a AS n, min(b) AS c FROM reach GROUP BY page_id, a),
block AS (SELECT page_id, c, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r JOIN part_of USING (page_id, n) GROUP BY page_id, c)"""


# Ink grows by a pixel on each side. Boxes at most two pixels apart are one; rounds double what a box has taken in.
_ROUNDS = 5
VISUAL_REGIONS = f"""
WITH RECURSIVE {_hanging(for_duckdb(RECTANGLES))},
g AS (SELECT page_id, greatest(0, x0 - 1) AS x0, greatest(0, y0 - 1) AS y0, least({WIDTH}, x1 + 1) AS x1, least({HEIGHT}, y1 + 1) AS y1 FROM block),
m0 AS MATERIALIZED (SELECT DISTINCT * FROM g WHERE (x1 - x0) * (y1 - y0) >= 0.015 * {WIDTH * HEIGHT} AND x1 - x0 >= 40 AND y1 - y0 >= 40)""" + "".join(
    f""",
m{i + 1} AS MATERIALIZED (SELECT DISTINCT page_id, x0, y0, x1, y1 FROM (
  SELECT a.page_id, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, min(b.x0) AS x0, min(b.y0) AS y0, max(b.x1) AS x1, max(b.y1) AS y1 FROM m{i} a JOIN m{i} b
  ON a.page_id = b.page_id AND a.x0 <= b.x1 + 2 AND b.x0 <= a.x1 + 2 AND a.y0 <= b.y1 + 2 AND b.y0 <= a.y1 + 2 GROUP BY ALL))"""
    for i in range(_ROUNDS)
) + f"""
SELECT page_id, CAST(k AS INT) AS k, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (x1 - x0) * (y1 - y0) DESC, y0, x0) - 1 AS k FROM m{_ROUNDS}) WHERE k < 8
"""

# Of 130 rows the first 101 are looked at.
MAIN_FIGURES = f"""
WITH RECURSIVE {_hanging(f"SELECT page_id, x0, greatest(y0, 10) AS y0, x1, least(y1, 111) AS y1 FROM ({for_duckdb(RECTANGLES)}) WHERE y1 > 10 AND y0 < 111")},
f AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM block WHERE (x1 - x0) * (y1 - y0) >= 0.08 * {WIDTH * 101} AND x1 - x0 >= 40 AND y1 - y0 >= 40 AND greatest((x1 - x0)::DOUBLE / (y1 - y0), (y1 - y0)::DOUBLE / (x1 - x0)) <= 12),
s AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY w * h + h * 200 - (y0 - 10) * 50 + least(w, 180) * 20 DESC, y0, x0) AS k FROM f)
SELECT page_id, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM s WHERE k = 1
"""

#: Fifty parts are a workbook, those of even keys its first sheet.
BOOKS = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS book, p_partkey AS key, p_name AS name, CAST(p_size AS STRING) AS size FROM <part>"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book_of(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="{name}" r:id="r{k}"/>' for k, name in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            cells = ("".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in row) for row in rows)
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>' + "".join(f"<row>{c}</row>" for c in cells) + "</sheetData></worksheet>")
    return out.getvalue()


def workbook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every sheet of the parts' workbooks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for rows in f["rows"]:
                of = lambda rest: [["key", "name", "size"], *([str(r["key"]), r["name"], r["size"]] for r in rows if r["key"] % 2 == rest)]  # noqa: B023, E731
                made.append(book_of({"even": of(0), "odd": of(1)}))
            yield pd.DataFrame({"path": f["book"].astype(str) + ".xlsx", "content": made})

    books = derived(spark, sf_dir, BOOKS).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("key", "name", "size"))).alias("rows"))  # fifty parts
    found = files.workbooks(books.mapInPandas(run, "path string, content binary"))
    return found.select("path", "sheet", "sheet_no", "row_no", F.concat_ws("|", "cells").alias("cells"))


WORKBOOK_SCAN = f"""
WITH p AS (SELECT *, CAST(key % 2 AS INT) AS n FROM ({for_duckdb(BOOKS)}))
SELECT book || '.xlsx' AS path, CASE n WHEN 0 THEN 'even' ELSE 'odd' END AS sheet, n AS sheet_no, CAST(row_number() OVER (PARTITION BY book, n ORDER BY key) AS INT) AS row_no, concat_ws('|', key, name, size) AS cells FROM p
UNION ALL SELECT book || '.xlsx', CASE n WHEN 0 THEN 'even' ELSE 'odd' END, CAST(n AS INT), 0, 'key|name|size' FROM (SELECT DISTINCT book FROM p), range(2) r(n)
"""

QUERIES = {
    "workbook_scan": (workbook_scan, WORKBOOK_SCAN),
    "image_pages": (image_pages, IMAGE_PAGES),
    "page_bands": (page_bands, PAGE_BANDS),
    "visual_regions": (visual_regions, VISUAL_REGIONS),
    "main_figures": (main_figures, MAIN_FIGURES),
}
