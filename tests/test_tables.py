import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import tables


#: Parts of a text, with what each must be found as: nothing, or a block of a kind that covers it.
PARTS = [
    (["text"], None), ([""], None), (["| a lone row |"], None), (["|"], None), (["|a|", "|b|"], "pipe"), (["| a | b |", "|---|---|", "  | i | j |  "], "pipe"),
    (["<table><tr></tr></table>"], "html"), (["x <TABLE a=1>", "", "| q | r |", "| s | t |", "</Table> y"], "html"), (["</table>"], None),
]


def built_docs(n=200):
    """Texts put together from PARTS, a plain line between any two, and the blocks that they hold by their making."""
    rng = random.Random(11)
    for _ in range(n):
        rows, blocks = [], []
        for part, kind in rng.choices(PARTS, k=rng.randint(0, 6)):
            if kind:
                blocks.append((len(rows), len(rows) + len(part) - 1, kind))
            rows += [*part, "between"]
        yield "\n".join(rows) + rng.choice(["", "\n"]), blocks


def test_blocks_are_found_where_they_were_put(spark):
    docs = list(built_docs())
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(docs)], "id int, md string")
    got = {r.id: [(b.start_line, b.end_line, b.kind) for b in r.b] for r in df.select("id", tables.blocks(F.col("md")).alias("b")).collect()}
    assert got == {i: b for i, (_, b) in enumerate(docs)}


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("| a | b |\n| c | d |\n<table>\n</table>\n| e | f |\n| g | h |", [(0, 1, "pipe"), (2, 3, "html"), (4, 5, "pipe")]),
        ("<table>\n| a | b |\n| c | d |", [(1, 2, "pipe")]),
        ("<table> <table>\n</table>\n</table>", [(0, 1, "html")]),
        ("| <table> | q |\n| </table> | r |", [(0, 1, "html")]),
    ],
)
def test_blocks_that_touch_or_never_end(spark, md, want):
    got = spark.createDataFrame([(md,)], "md string").select(tables.blocks(F.col("md"))).first()[0]
    assert [(b.start_line, b.end_line, b.kind) for b in got] == want


def test_cells_come_back_from_the_row_made_of_them(spark):
    rng = random.Random(5)
    cells = [["".join(rng.choices(["a", "é", " b", "\\|", "\\\\", "x y"], k=rng.randint(0, 4))).strip() for _ in range(rng.randint(1, 5))] for _ in range(120)]
    rows = [(i, f"{rng.choice(['', '  '])}| {' | '.join(c)} |{rng.choice(['', ' '])}") for i, c in enumerate(cells)]
    got = {r.id: r.c for r in spark.createDataFrame(rows, "id int, line string").select("id", tables.split_row(F.col("line")).alias("c")).collect()}
    assert got == dict(enumerate(cells))
    odd = {"a": ["a"], "||": [""], "a||b": ["a", "", "b"], "|a\\|b|": ["a\\|b"], "": [""]}
    for line, want in odd.items():
        assert spark.createDataFrame([(line,)], "line string").select(tables.split_row(F.col("line"))).first()[0] == want


def test_lines_end_where_python_ends_them(spark):
    docs = ["a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h\u2029", "\n", "\n\n", "x\r\n", "", "plain"]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, md string").select("id", text.lines(F.col("md")).alias("l")).collect()
    assert {r.id: r.l for r in rows} == {i: d.splitlines() for i, d in enumerate(docs)}


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("| a | b | c |\n|---|---|---|\n| 1 |\n| 1 | 2 | 3 | 4 |\nend", "| a | b | c |\n| --- | --- | --- |\n| 1 |  |  |\n| 1 | 2 | 3 \\| 4 |\nend".replace("\\|", "|")),
        ("| a |\n|---|\n| 1 | 2 |", "| a |\n|---|\n| 1 | 2 |"),
        ("x | y\n--- | :---:\n1 | 2\n\n3 | 4", "| x | y |\n| --- | --- |\n| 1 | 2 |\n\n3 | 4"),
        ("", ""),
        ("| a | b |\n| -- | --- |\n", "| a | b |\n| -- | --- |"),
    ],
)
def test_normalize(spark, md, want):
    assert spark.createDataFrame([(md,)], "md string").select(tables.normalize(F.col("md"))).first()[0] == want


def value(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols)).select(expr).first()[0]


HTML = '<table><tr><th colspan="2">h</th><td>x</td></tr>\n<tr><td>1</td></tr></table>'


def test_counts(spark):
    assert value(spark, tables.column_count(F.col("t")), t=HTML) == 3
    assert value(spark, tables.html_rows(F.col("t")), t=HTML) == 2
    assert value(spark, tables.column_count(F.col("t")), t="text\n| a \\| b | c |") == 3
    assert value(spark, tables.column_count(F.col("t")), t="none") == 0
    assert value(spark, tables.first_block(F.col("t")), t="x\n| one |\n\n| a | b |") == "| one |"


@pytest.mark.parametrize(
    ("a", "b", "reason"),
    [
        ("| a | b |\n|---|---|", "| a | c |\n|---|---|", None),
        ("| a | b |", " ", "empty_output"),
        ("| a | b |", HTML, "table_format_changed"),
        (HTML, HTML.replace("<tr><td>1</td></tr>", ""), "row_count_changed"),
        (HTML, HTML.replace(' colspan="2"', ""), "column_count_changed"),
        ("| a | b |\n|---|---|", "| a | b |", "row_count_changed"),
        ("| a | b |\n|---|---|", "| a | b |\n|---|", "row_column_count_changed"),
        ("no table", "no table", "orig_col_count_invalid"),
    ],
)
def test_invariants(spark, a, b, reason):
    got = value(spark, tables.invariants(F.col("a"), F.col("b")), a=a, b=b)
    assert (got.ok, got.reason) == (reason is None, reason)


@pytest.mark.parametrize(("md", "odd"), [("| a | b |\n|---|---|\n| 1 |", True), ("| a | b |\n|---|---|\n| 1 | 2 |", False), ("|" + "h|" * 8 + "\n|" + "---|" * 8, True), (HTML, False), ("| a | b |\n|---|---|\n| | |", True)])
def test_suspicious(spark, md, odd):
    assert value(spark, tables.is_suspicious(F.col("t")), t=md) == odd
