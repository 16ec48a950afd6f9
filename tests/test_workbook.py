import zipfile

from foliant.sources import files

HEAD = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'


def made(path, sheets, broken=()):
    """A workbook of sheets {name: rows of cells}; the sheets in `broken` can't be parsed."""
    texts = sorted({c for rows in sheets.values() for row in rows for c in row})
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{name}" r:id="r{k}"/>' for k, name in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{"/xl/" * (k % 2)}worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        for k, (name, rows) in enumerate(sheets.items()):
            cells = lambda row: "".join(f'<c t="s"><v>{texts.index(c)}</v></c>' for c in row)
            body = "".join(f"<row>{cells(row)}</row>" for row in rows)
            z.writestr(f"xl/worksheets/s{k}.xml", (HEAD.replace("<sheetData>", f'<dimension ref="A1:C{len(rows)}"/><sheetData>') if k % 2 == 0 else HEAD) + body + ("<row><c>" if name in broken else "</sheetData></worksheet>"))


SHEETS = {"one": [[f"a{i}", f"b{i % 3}", f"c{i}"][: 1 + i % 3] for i in range(50)], "two": [["x", "y"]], "none": [], "bad": [["z"]] * 9}


def test_the_source_reads_only_what_filters_ask_for(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    made(path, SHEETS, broken=("bad",))
    read = lambda **options: files.workbook(spark, path, **options)
    want = [(name, k, n, row) for k, (name, rows) in enumerate(SHEETS.items()) if name != "bad" for n, row in enumerate(rows)]
    rows = lambda df: sorted((r.sheet, r.sheet_no, r.row_no, r.cells) for r in df.collect())
    every = read().where("sheet_no < 3")  # the last sheet can't be parsed: it isn't opened
    assert rows(every) == sorted(want)
    assert rows(read(partition_rows=7).where("sheet_no <= 2")) == sorted(want)
    assert rows(read().where("sheet = 'two'")) == [("two", 1, 0, ["x", "y"])]
    some = read(partition_rows=5).where("sheet = 'one' AND row_no >= 10 AND row_no < 22")
    assert some.rdd.getNumPartitions() == 3
    assert rows(some) == [w for w in want if w[0] == "one" and 10 <= w[2] < 22]
    assert rows(read().where("sheet_no = 3 AND row_no <= 4")) == [("bad", 3, n, ["z"]) for n in range(5)]  # what is broken lies behind
    assert rows(read().where("sheet_no = 9")) == rows(read().where("sheet_no = 0 AND row_no < 0")) == []
    few = read(columns="2, 0").where("sheet_no = 0")
    assert rows(few) == [("one", 0, n, [row[2] if len(row) > 2 else "", row[0]]) for n, row in enumerate(SHEETS["one"])]
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert read(partition_rows=7).where("sheet_no = 0").rdd.getNumPartitions() == 8 and read(partition_rows=7).where("sheet_no = 1").rdd.getNumPartitions() == 1


def test_filters_that_are_not_bounds_stay(tmp_path):
    made(str(tmp_path / "book.xlsx"), {"one": [["a"]] * 3, "two": [["b"]]})
    reader = files.FilteredWorkbookReader(str(tmp_path / "book.xlsx"), [], 2)
    left = list(reader.pushFilters([files.GreaterThan(("row_no",), 0), files.EqualTo(("cells",), "x"), files.EqualTo(("sheet",), "one"), files.EqualTo(("sheet",), "two")]))
    assert [f.attribute for f in left] == [("cells",), ("sheet",)]
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert got == [("one", 0, 1, ["a"]), ("one", 0, 2, ["a"])]


def test_a_large_sheet_is_read_row_by_row(tmp_path):
    path = str(tmp_path / "long.xlsx")
    made(path, {"long": [["v", "w"]] * 40000}, broken=("long",))
    with open(path, "rb") as f:
        book = files.Workbook(f)
        assert [n for n, _ in book.rows(0, 39000, 39002)] == [39000, 39001, 39002]
