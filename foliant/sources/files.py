"""Scanning folders and reading documents: files, pages, HTML, workbooks. Other formats plug in as extractors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from foliant.functions.text import suffix

#: Suffixes by what reads them.
LAYOUT = (".pdf", ".docx", ".pptx", ".html", ".htm", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
WORKBOOK = (".xlsx",)
IMAGE = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
IMAGE_HEADS = (b"\x89PNG", b"\xff\xd8\xff", b"II*\0", b"MM\0*", b"BM")


def is_supported(path: Column, allowed: Iterable[str] = (*LAYOUT, *WORKBOOK)) -> Column:
    """A known suffix, and a name that doesn't begin with a dot."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return suffix(path).isin(*allowed) & ~name.startswith(".")


def extension_error(name: Column, allowed: Iterable[str]) -> Column:
    """Why a file isn't taken; null if it is. allowed: without dots."""
    s = F.regexp_replace(suffix(name), r"^\.", "")
    return F.when(s == "", "missing_extension").when(~s.isin(*allowed), "not_allowed")


def scan(spark: SparkSession, root: str, allowed: Iterable[str] = (*LAYOUT, *WORKBOOK), most: int = 0) -> DataFrame:
    """Supported files below a folder (path, modificationTime, length, content), in order of path; 0: all.

    Names and folders that begin with _ or a dot are hidden from Spark's readers.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(is_supported(F.col("path"), allowed)).orderBy("path")
    return found.limit(most) if most > 0 else found


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths and sizes alone: file contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")


def route(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*WORKBOOK), "workbook").when(s.isin(".html", ".htm"), "html").when(s.isin(*IMAGE), "image").when(s.isin(*LAYOUT), "layout").otherwise("unsupported")


def upload_errors(files: DataFrame, limit: int, kind: str) -> DataFrame:
    """files (job_id, pos, name, length) with error: the size limit holds for each file, or over a folder's running sum."""
    from pyspark.sql import Window

    total = F.sum("length").over(Window.partitionBy("job_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    size = total if kind == "folder" else F.col("length")
    return files.withColumn("error", F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "missing_name").when(size > limit, "too_large"))


def paired(files: DataFrame, paths: DataFrame) -> DataFrame:
    """files (job_id, pos, name, …) with relative_path, by position, and error: where a job's two lists are not of one length, or a path climbs."""
    from pyspark.sql import Window

    from foliant.operators.jobs import safe_path

    joined = files.join(paths.select("job_id", "pos", F.col("relative_path").alias("raw"), F.lit(True).alias("given")), ["job_id", "pos"], "full")
    short = F.max(F.when(F.col("name").isNull() | F.col("given").isNull(), 1).otherwise(0)).over(Window.partitionBy("job_id"))
    error = F.when(short == 1, "count_mismatch").when(safe_path(F.col("raw")).isNull(), "bad_path")
    return joined.withColumn("relative_path", safe_path(F.col("raw"))).withColumn("error", error).drop("raw", "given")


# HTML

BLOCK = {"p", "div", "section", "article", "ul", "ol", "br", "table", "blockquote", "pre", "main", "body"}
SKIPPED = {"script", "style", "head", "nav", "footer", "header", "template", "noscript"}


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, links, images and tables; page furniture is left out."""

    def __init__(self, furniture: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden, self.link, self.furniture = 0, [], furniture
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def write(self, text: str) -> None:
        (self.out if self.cell is None else self.cell).append(text)

    def hides(self, tag: str) -> bool:
        return tag in SKIPPED and not (self.furniture and tag in ("nav", "footer", "header"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        if self.hides(tag):
            self.hidden += 1
        elif self.hidden:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.write("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.write("\n- ")
        elif tag == "a":
            self.link.append(own.get("href") or "")
            self.write("[")
        elif tag == "img":
            self.write(f"![{own.get('alt') or ''}]({own.get('src') or ''})")
        elif tag == "tr":
            self.rows = [*(self.rows or []), []]
        elif tag in ("td", "th") and self.rows:
            self.cell = []
        elif tag in BLOCK:
            self.write("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if self.hides(tag):
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag == "a" and self.link:
            self.write(f"]({self.link.pop()})")
        elif tag in ("td", "th") and self.cell is not None:
            text, self.cell = " ".join("".join(self.cell).split()).replace("|", "\\|"), None
            self.rows[-1].append(text)
        elif tag == "table" and self.rows:
            width = max(map(len, self.rows))
            rows = [r + [""] * (width - len(r)) for r in self.rows if r]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            self.rows = None
            self.write("\n\n" + "\n".join([*lines[:1], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) + "\n\n")
        elif tag in BLOCK or re.fullmatch("h[1-6]", tag):
            self.write("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden and not (self.rows is not None and self.cell is None):
            self.write(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None, furniture: bool = False, references: Iterable[str] | None = None) -> str:
    """references: names of the character references that stand for a sign, closed by a semicolon; others stay as they are
    written. None: all that HTML knows, closed or not."""
    parser = _Markdown(furniture)
    html = html or ""
    parser.feed(html if references is None else re.sub(rf"&(?!(?:{'|'.join(references)});)", "&amp;", html))
    parser.close()
    lines = [x.strip() if not x.strip().startswith("|") else x.strip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def with_markdown(pages: DataFrame, html_col: str = "html", furniture: bool = False, references: Iterable[str] | None = None) -> DataFrame:
    """`pages` with `markdown`, an Arrow batch at a time. furniture: whether headers, footers and navigation stay; references: see html_to_markdown()."""

    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda x: html_to_markdown(x, furniture, references))

    return pages.withColumn("markdown", F.pandas_udf(run, "string")(html_col))


# Workbooks and Office texts

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref).group():
        n = 26 * n + ord(c) - 64
    return n - 1


class Workbook:
    """An open .xlsx file: its sheets are listed at once, and a sheet is read only when its rows are asked for, row by row."""

    def __init__(self, file: BinaryIO) -> None:
        self.zip = zipfile.ZipFile(file)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")
        paths = [(s.get("name"), targets[s.get(_REL)].lstrip("/")) for s in sheets]
        self.sheets = [(name, path if path.startswith("xl/") else f"xl/{path}") for name, path in paths]
        self.texts: list[str] | None = None

    def shared(self, number: int) -> str:
        """A text that cells share; all of them are read when the first one is needed."""
        if self.texts is None:
            found = ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in self.zip.namelist() else ()
            self.texts = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in found if s.tag == f"{_SHEET}si"]
        return self.texts[number]

    def extent(self, k: int) -> int | None:
        """How many rows sheet k says that it has, which is no less than it holds; None if its head doesn't say."""
        with self.zip.open(self.sheets[k][1]) as f:
            for _, tag in ElementTree.iterparse(f, ("start",)):
                if tag.tag == f"{_SHEET}dimension":
                    found = re.search(r"(\d+)$", tag.get("ref") or "")
                    return int(found.group()) if found else None
                if tag.tag == f"{_SHEET}sheetData":
                    return None
        return None

    def rows(self, k: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, list[str]]]:
        """(row number, cells as text) of the rows first to last of sheet k. What lies behind is not parsed, and of what is
        passed by no cell is read."""
        with self.zip.open(self.sheets[k][1]) as f:
            n = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_SHEET}row":
                    continue
                if last is not None and n > last:
                    return
                if n >= first:
                    yield n, self.cells(row)
                row.clear()
                n += 1

    def cells(self, row: ElementTree.Element) -> list[str]:
        out: list[str] = []
        for c in row.iter(f"{_SHEET}c"):
            at = _column(c.get("r") or "") if c.get("r") else len(out)
            value = c.find(f"{_SHEET}v")
            if c.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
            elif value is None:
                text = ""
            else:
                text = self.shared(int(value.text)) if c.get("t") == "s" else value.text or ""
            out += [""] * (at - len(out)) + [text]
        return out


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    """(sheet, sheet number, row number, cells as text) of an .xlsx file; row 0 is the header."""
    book = Workbook(io.BytesIO(content))
    for k, (name, _) in enumerate(book.sheets):
        for n, cells in book.rows(k):
            yield name, k, n, cells


class SheetRows(InputPartition):
    """Rows first to last of one sheet."""

    def __init__(self, sheet_no: int, first: int, last: int | None) -> None:
        self.sheet_no, self.first, self.last = sheet_no, first, last


class WorkbookSource(DataSource):
    """`spark.read.format("workbook").load(path)`: a row for each row of each sheet of an .xlsx file.

    Options: path; columns, a comma list of column numbers from 0: the cells returned, in that order, empty where a row
    has none; partition_rows: rows of a sheet that one task returns (0: a sheet is one task); pushdown: true where the session
    pushes filters into Python (`workbook` sees to it). Then equality of sheet and sheet_no, and comparisons of sheet_no
    and row_no with a constant, reach the reader: other sheets are not opened, rows behind the last one wanted not parsed.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, sheet_no int, row_no int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        columns = [int(c) for c in self.options.get("columns", "").split(",") if c.strip()]
        kind = FilteredWorkbookReader if self.options.get("pushdown") == "true" else WorkbookReader
        return kind(self.options["path"].removeprefix("file://"), columns, int(self.options.get("partition_rows", 0)))


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, columns: list[int], partition_rows: int) -> None:
        self.path, self.columns, self.partition_rows = path, columns, partition_rows
        self.bounds: dict[str, list[int | None]] = {"sheet_no": [0, None], "row_no": [0, None]}
        self.sheet: str | None = None

    def partitions(self) -> list[InputPartition]:
        """Row ranges of the sheets wanted; a sheet that doesn't say how long it is, is one. The last range has no end of its
        own. Of a sheet only the head is read here."""
        (low, high), (first, last) = self.bounds["sheet_no"], self.bounds["row_no"]
        if last is not None and last < first:
            return [SheetRows(-1, 0, -1)]
        out = []
        with open(self.path, "rb") as f:
            book = Workbook(f)
            for k, (name, _) in enumerate(book.sheets):
                if k < low or (high is not None and k > high) or self.sheet not in (None, name):
                    continue
                end = book.extent(k) if self.partition_rows and last is None else last
                starts = list(range(first, max(first, end) + 1, self.partition_rows)) if self.partition_rows and end is not None else [first]
                out += [SheetRows(k, a, b - 1) for a, b in zip(starts, starts[1:], strict=False)] + [SheetRows(k, starts[-1], last)]
        return out or [SheetRows(-1, 0, -1)]

    def read(self, partition: SheetRows) -> Iterator[tuple]:
        if partition.sheet_no < 0:
            return
        with open(self.path, "rb") as f:
            book = Workbook(f)
            name = book.sheets[partition.sheet_no][0]
            for n, cells in book.rows(partition.sheet_no, partition.first, partition.last):
                picked = [cells[c] if c < len(cells) else "" for c in self.columns] if self.columns else cells
                yield name, partition.sheet_no, n, picked


class FilteredWorkbookReader(WorkbookReader):
    """With filters; Spark refuses such a reader in a session that doesn't push filters into Python."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        """Takes bounds of sheet and row numbers and the name of a sheet, and gives back the rest."""
        for f in filters:
            column, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if value is not None and column in self.bounds and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                first, last = self.bounds[column]
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    first = max(first, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    top = value - isinstance(f, LessThan)
                    last = top if last is None else min(last, top)
                self.bounds[column] = [first, last]
            elif value is not None and column == "sheet" and isinstance(f, EqualTo) and self.sheet in (None, value):
                self.sheet = value
            elif not (isinstance(f, IsNotNull) and column in ("sheet", "sheet_no", "row_no")):  # these are never null
                yield f


def workbook(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The rows of one workbook, with filters pushed into the reader; see WorkbookSource for the options."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").options(pushdown="true", **options).load(path)


def workbooks(files: DataFrame) -> DataFrame:
    """files (path, content) as (path, sheet, sheet_no, row_no, cells): any store that Spark reads."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, c in zip(f["path"], f["content"], strict=True) for r in workbook_rows(c)]
            yield pd.DataFrame(rows, columns=["path", "sheet", "sheet_no", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, sheet_no int, row_no int, cells array<string>")


def office_pages(name: str, content: bytes) -> list[str]:
    """The text of a .docx (one page) or a .pptx (a page a slide)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if name.lower().endswith(".docx"):
            root = ElementTree.fromstring(z.read("word/document.xml"))
            return ["\n\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))]
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        return ["\n".join("".join(t.text or "" for t in p.iter(f"{_DRAW}t")) for p in ElementTree.fromstring(z.read(n)).iter(f"{_DRAW}p")) for n in slides]


#: An extractor yields a file's pages: (body, failed).
Extractor = Callable[[str, bytes], Iterable[tuple[str, bool]]]


def standard_extractor(name: str, content: bytes) -> Iterator[tuple[str, bool]]:
    low = name.lower()
    if low.endswith((".html", ".htm")):
        yield html_to_markdown(content.decode("utf-8", "replace")), False
    elif low.endswith((".docx", ".pptx")):
        yield from ((p, False) for p in office_pages(name, content))
    elif low.endswith(IMAGE):
        base = name.replace("\\", "/").rpartition("/")[2]
        fine = content.startswith(IMAGE_HEADS) or content[8:12] == b"WEBP"
        yield (f"![{base.rpartition('.')[0]}](images/{base})", False) if fine else ("（图片读取失败）", True)
    else:
        yield "", True


def page_limit(pages: int, most: int | None) -> int:
    return pages if most is None else min(pages, max(1, most))


def pages(files: DataFrame, extract: Extractor = standard_extractor, most: int | None = None) -> DataFrame:
    """(path, page_no, body, failed): a file that can't be read is one failed page. The limit stops the extractor itself."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    for k, (body, failed) in enumerate(extract(path, content), 1):
                        rows.append((path, k, body, failed))
                        if most is not None and k >= max(1, most):
                            break
                except Exception:  # noqa: BLE001  any broken file
                    rows.append((path, 1, "", True))
            yield pd.DataFrame(rows, columns=["path", "page_no", "body", "failed"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, body string, failed boolean")
