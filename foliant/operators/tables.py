"""Markdown and HTML tables as Column expressions over a text or its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import count_of, join_lines, let, lines, strip
from foliant.model import TABLE_BLOCK


def is_pipe_line(line: Column) -> Column:
    t = strip(line)
    return t.startswith("|") & (count_of(t, "|") >= 2)


def split_row(line: Column) -> Column:
    """Cells of a pipe row: one outer pipe off each end, `\\|` within a cell kept, cells stripped."""
    t = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.regexp_extract_all(F.concat(t, F.lit(" |")), F.lit(r"((?s:\\.|[^|\\])*)\|"), F.lit(1)), strip)


def naive_cells(line: Column) -> Column:
    """Cells between all pipes, escaped or not; an empty first and last one dropped."""
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\s*\|", ""), r"\|\s*$", "")
    return F.transform(F.split(inner, r"\|", -1), strip)


def is_separator(line: Column) -> Column:
    return F.forall(split_row(line), lambda c: c.rlike("^:?-{3,}:?$"))


def format_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def fitted_row(cells: Column, width: Column) -> Column:
    """Exactly `width` cells: short rows are padded, what is over joins the last cell."""
    size = F.size(cells)
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - size, F.lit(0))))
    tail = F.array_join(F.slice(cells, width, F.greatest(size - width + 1, F.lit(0))), " | ")
    return F.when(size > width, F.concat(F.slice(cells, 1, width - 1), F.array(tail))).otherwise(padded)


def normalize(markdown: Column) -> Column:
    """Every pipe table with a separator row rewritten so that all its rows have the header's width."""

    def marked(rows: Column) -> Column:
        def mark(line: Column, after: Column) -> Column:
            rule = F.coalesce(line.contains("|") & after.contains("|") & is_separator(after), F.lit(False))
            return let(split_row(line), lambda c: F.struct(line.alias("line"), c.alias("cells"), (rule & (F.size(c) > 1)).alias("head"), (line.contains("|") & (strip(line) != "")).alias("row")))

        return F.filter(F.zip_with(rows, F.slice(rows, 2, F.size(rows)), mark), lambda m: m["line"].isNotNull())

    start = F.struct(F.lit(0).alias("width"), F.lit(False).alias("rule"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        body = (s["width"] > 0) & r["row"] & ~s["rule"]
        begins = ~s["rule"] & ~body & r["head"]
        text = (
            F.when(s["rule"], format_row(F.array_repeat(F.lit("---"), s["width"])))
            .when(body, format_row(fitted_row(r["cells"], s["width"])))
            .when(begins, format_row(r["cells"]))
            .otherwise(r["line"])
        )
        width = F.when(s["rule"] | body, s["width"]).when(begins, F.size(r["cells"])).otherwise(0)
        return F.struct(width.alias("width"), begins.alias("rule"), F.array_append(s["out"], text).alias("out"))

    return join_lines(F.aggregate(let(lines(markdown), marked), start, step, lambda s: s["out"]))


def blocks(markdown: Column) -> Column:
    """Table blocks of a text, in order: HTML from `<table` to `</table>`, pipe runs of two lines or more."""
    return let(lines(markdown), blocks_of_lines)


def blocks_of_lines(rows: Column) -> Column:
    """blocks() of a text that is split already."""
    marks = F.transform(
        rows,
        lambda x, i: F.struct(i.alias("i"), F.lower(x).contains("<table").alias("opens"), F.lower(x).contains("</table>").alias("shuts"), is_pipe_line(x).alias("pipe")),
    )
    last = F.coalesce(F.array_max(F.transform(F.filter(marks, lambda m: m["shuts"]), lambda m: m["i"])), F.lit(-1))
    found = "array<struct<start_line:int,end_line:int,kind:string>>"
    start = F.struct(F.lit("").alias("mode"), F.lit(-1).alias("from"), F.array().cast(found).alias("out"))

    def block(lo: Column, hi: Column, kind: str) -> Column:
        return F.array(F.struct(lo.cast("int").alias("start_line"), hi.cast("int").alias("end_line"), F.lit(kind).alias("kind")))

    def step(s: Column, m: Column, last: Column) -> Column:
        none = F.array().cast(found)
        in_html, in_pipe = s["mode"] == "html", (s["mode"] == "pipe") & m["pipe"]
        ended = F.when((s["mode"] == "pipe") & ~m["pipe"] & (m["i"] - s["from"] >= 2), block(s["from"], m["i"] - 1, "pipe")).otherwise(none)
        fresh = ~in_html & ~in_pipe
        opens = fresh & m["opens"] & (last >= m["i"])
        shut = F.when((in_html | opens) & m["shuts"], block(F.when(in_html, s["from"]).otherwise(m["i"]), m["i"], "html")).otherwise(none)
        mode = F.when((in_html | opens) & m["shuts"], "").when(in_html | opens, "html").when(m["pipe"], "pipe").otherwise("")
        begin = F.when(in_html | in_pipe, s["from"]).otherwise(m["i"])
        found_one = (F.size(ended) > 0) | (F.size(shut) > 0)  # most lines end none, and copy nothing
        return F.struct(mode.alias("mode"), begin.alias("from"), F.when(found_one, F.concat(s["out"], ended, shut)).otherwise(s["out"]).alias("out"))

    def finish(s: Column) -> Column:
        n = F.size(rows)
        return F.when((s["mode"] == "pipe") & (n - s["from"] >= 2), F.concat(s["out"], block(s["from"], n - 1, "pipe"))).otherwise(s["out"])

    whole = lambda b: F.struct(b["start_line"], b["end_line"], join_lines(F.slice(rows, b["start_line"] + 1, b["end_line"] - b["start_line"] + 1)).alias("markdown"), b["kind"])
    spans = let(F.struct(marks.alias("marks"), last.alias("last")), lambda v: F.aggregate(v["marks"], start, lambda s, m: step(s, m, v["last"]), finish))
    return F.transform(spans, whole).cast(f"array<{TABLE_BLOCK}>")


def first_block(text: Column) -> Column:
    """The first run of pipe lines, single ones included; '' if there is none."""

    def cut(v: Column) -> Column:
        begin = F.array_position(v["flags"], True)
        rest = F.slice(v["flags"], F.greatest(begin, F.lit(1)), F.size(v["flags"]))
        size = let(F.array_position(rest, False), lambda end: F.when(end > 0, end - 1).otherwise(F.size(rest)).cast("int"))
        return F.when(begin > 0, strip(join_lines(F.slice(v["rows"], begin.cast("int"), size)))).otherwise("")

    return let(let(lines(text), lambda rows: F.struct(rows.alias("rows"), F.transform(rows, is_pipe_line).alias("flags"))), cut)


def is_html_table(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains("<table") & low.contains("</table>")


def html_rows(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?i)<tr\b"))


def html_columns(text: Column) -> Column:
    """Cells of the first row, each as wide as its colspan."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)<tr\b[^>]*>(.*?)</tr>", 1)
    cells = F.regexp_extract_all(first, F.lit(r"(?i)<t[dh]\b([^>]*)>"), F.lit(1))
    width = lambda a: F.greatest(F.lit(1), F.coalesce(F.nullif(F.regexp_extract(a, r"(?i)colspan\s*=\s*[\"']?(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1)))
    return F.aggregate(F.transform(cells, width), F.lit(0), lambda a, b: a + b)


def column_count(markdown: Column) -> Column:
    """Columns of an HTML table's first row, or of the first pipe line, escapes not heeded."""
    first = F.get(F.filter(lines(markdown), is_pipe_line), F.lit(0))
    return F.when(is_html_table(markdown), html_columns(markdown)).otherwise(F.coalesce(F.size(naive_cells(first)), F.lit(0)) * first.isNotNull().cast("int"))


def pipe_rows(markdown: Column) -> Column:
    return F.filter(lines(markdown), lambda x: strip(x).startswith("|"))


def share_of_empty(cells: Column) -> Column:
    """Share of empty cells below the second row. cells: a row's cells, row by row."""
    return let(F.flatten(F.slice(cells, 3, 1 << 20)), lambda c: F.when(F.size(c) > 0, F.size(F.filter(c, lambda x: x == "")) / F.size(c)).otherwise(0.0))


def empty_share(markdown: Column) -> Column:
    """share_of_empty() of a table's pipe rows."""
    return let(F.transform(pipe_rows(markdown), split_row), share_of_empty)


def is_suspicious(markdown: Column) -> Column:
    """Whether a pipe table is worth a second look: many columns, ragged rows, or many empty cells."""

    def odd(t: Column) -> Column:
        ragged = (t["width"] >= 8) | F.exists(t["cells"], lambda c: F.size(c) != t["width"]) | (share_of_empty(t["cells"]) > 0.4)
        return (F.size(t["cells"]) >= 2) & (t["width"] > 1) & ragged

    return let(markdown, lambda md: let(F.struct(F.transform(pipe_rows(md), split_row).alias("cells"), column_count(md).alias("width")), odd))


def is_caption_worthy(markdown: Column) -> Column:
    def fine(v: Column) -> Column:
        first = strip(F.get(v["rows"], F.lit(0)))
        return (F.size(v["rows"]) >= 3) & first.startswith("|") & (count_of(first, "|") >= 3) & (F.length(v["text"]) >= 40)

    parts = lambda md: F.struct(F.filter(lines(md), lambda x: strip(x) != "").alias("rows"), strip(md).alias("text"))
    return F.coalesce(let(let(markdown, parts), fine), F.lit(False))


def invariants(original: Column, refined: Column) -> Column:
    """struct(ok, reason): whether a rewritten table keeps the first one's rows and columns; the first reason counts."""
    def facts(t: Column) -> Column:
        def of_parts(v: Column) -> Column:
            first = F.get(F.filter(v["l"], is_pipe_line), F.lit(0))
            width = F.when(v["html"], html_columns(t)).otherwise(let(first, lambda x: F.when(x.isNull(), 0).otherwise(F.size(naive_cells(x)))))
            return F.struct(v["html"], width.alias("width"), F.when(v["html"], html_rows(t)).alias("tr"), F.filter(v["l"], lambda x: strip(x).startswith("|")).alias("rows"))

        return let(F.struct(is_html_table(t).alias("html"), lines(t).alias("l")), of_parts)

    width = lambda r: F.when(is_pipe_line(r), F.size(naive_cells(r))).otherwise(0)

    def verdict(v: Column) -> Column:
        a, b, html = v["a"], v["b"], v["a"]["html"]
        reason = (
            F.when(v["empty"], "empty_output")
            .when(html != b["html"], "table_format_changed")
            .when(html & (a["tr"] != b["tr"]), "row_count_changed")
            .when(html & ((a["width"] <= 0) | (b["width"] <= 0)), "col_count_invalid")
            .when(html & (a["width"] != b["width"]), "column_count_changed")
            .when(html, None)
            .when(F.size(a["rows"]) != F.size(b["rows"]), "row_count_changed")
            .when(a["width"] == 0, "orig_col_count_invalid")
            .when(F.exists(b["rows"], lambda r: width(r) != a["width"]), "row_column_count_changed")
        )
        return let(reason, lambda r: F.struct(r.isNull().alias("ok"), r.alias("reason")))

    def of_both(t: Column) -> Column:
        blank = strip(F.coalesce(t["b"], F.lit(""))) == ""
        return let(F.struct(facts(t["a"]).alias("a"), facts(t["b"]).alias("b"), blank.alias("empty")), verdict)

    return let(F.struct(original.alias("a"), refined.alias("b")), of_both)


def export(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, markdown): each key's rows, in order, as one pipe table; null cells are empty."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    head = F.concat_ws("\n", format_row(F.array(*[F.lit(c) for c in columns])), format_row(F.array(*[F.lit("---") for _ in columns])))
    body = F.transform(F.array_sort(F.collect_list(F.struct(*order, format_row(cells).alias("__row")))), lambda r: r["__row"])  # one table
    return rows.groupBy(key).agg(F.concat_ws("\n", head, F.array_join(body, "\n")).alias("markdown"))


def join_sheets(name: Column, sheets: Column) -> Column:
    """A workbook's text. sheets: array<struct<name, markdown>>."""
    parts = F.transform(sheets, lambda s: F.concat(F.lit("## Sheet: "), s["name"], F.lit("\n\n"), s["markdown"], F.lit("\n")))
    return F.concat(F.lit("# "), name, F.lit("\n\n"), F.array_join(parts, "\n"))
