import base64
import io
import os
import sys
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import config, model
from foliant.functions import text
from foliant.operators import figures, images, jobs, matching, model_calls, raster, review
from foliant.plans import pipeline
from foliant.sources import files, sinks
from foliant.streaming import queue


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols)).select(expr).first()[0]


def test_settings():
    s = config.Settings.read({"MAX_FILE_SIZE": "1.5MB", "ALLOWED_FILE_TYPES": " .PDF, docx,,pdf", "PDF_VL_WORKERS": "900", "LLM_TIMEOUT_SEC": "3", "LOW_MEMORY": "Yes", "OCR_QUALITY": "high"})
    assert (s.max_file_size, s.allowed_types, s.page_workers, s.llm_timeout) == (1572864, ("pdf", "docx"), 64, 30.0)
    assert s.effective_ocr_quality == "fast" and s.rerun("high", "fast", True).page_images is False
    assert replace(s, low_memory=False).rerun("high", "fast", True).page_images is True
    assert config.first_given(None, 3, 4) == 3 and config.parse_size("", 7) == 7 and config.parse_bool(None, True)


def test_captions_and_labels(spark):
    md = "图 1.2-3 view [[position: 左上]]\n![alt](a.png)\n图A2。"
    got = one(spark, figures.captions(F.col("t"), 1), t=md)
    assert [(c.line_index, c.text, c.position) for c in got] == [(0, "图 1.2-3 view", "左上")]
    assert one(spark, images.label(text.lines(F.col("t")), F.lit(1), F.lit("alt")), t=md) == "图 1.2-3"
    assert one(spark, images.label(text.lines(F.col("t")), F.lit(0), F.lit("x")), t="![x](y)") == images.DEFAULT_LABEL


def test_box_merging():
    boxes = [(0, 0, 10, 10), (12, 0, 20, 10), (100, 100, 120, 120), (18, 8, 30, 30)]
    assert sorted(figures.merged_boxes(boxes, gap=3)) == [(0.0, 0.0, 30.0, 30.0), (100.0, 100.0, 120.0, 120.0)]


def test_matching_prefers_the_place_that_a_caption_names(spark):
    boxes = [(50, 50, 350, 300), (600, 450, 900, 750)]
    rows = [(1, ["左上", "右下"], [tuple(map(float, b)) for b in boxes]), (2, ["上"], []), (3, [None, " 中 ", None], [(10.0, 300.0, 200.0, 500.0)])]
    pages = spark.createDataFrame(rows, f"page_id long, positions array<string>, boxes array<{model.BOX}>")
    got = {(r.page_id, r.k): (r.x0, r.y0, r.x1, r.y1) for r in matching.match_page_captions(pages, 1000, 800).collect()}
    assert got[1, 0][:2] == (50, 50) and got[1, 1][2:] == (900, 750)
    assert got[2, 0] == (80, 40, 920, 360)
    assert got[3, 0] == (10, 300, 200, 500) and got[3, 1] == (80, 280, 920, 520) and got[3, 2] == (80, 546, 920, 786)


def test_raster(spark, tmp_path):
    page = np.full((60, 50), 255, dtype=np.uint8)
    page[10:30, 5:45] = 0
    page[40:55, 8:40] = 0
    assert raster.ink_box(page) == (5, 10, 45, 55) and raster.trim_box(page, pad=0) == (0, 0, 50, 60)
    assert raster.trim_box(page, pad=4) == (1, 6, 49, 59)
    assert raster.bands(raster.row_density(page)) == [(10, 30), (40, 55)] and raster.bands(raster.row_density(page), gap=10) == [(10, 55)]
    row = [(60, 50, 1, page.tobytes())]
    df = spark.createDataFrame(row, "height int, width int, nChannels int, data binary").select(F.struct("height", "width", "nChannels", "data").alias("image"))
    got = df.select(raster.content_box(F.col("image")).alias("b"), F.size(raster.density(F.col("image"))).alias("n"), raster.trimmed(F.col("image")).alias("t")).first()
    assert tuple(got.b) == (5, 10, 45, 55) and got.n == 60 and tuple(got.t) == (0, 0, 50, 60)


def test_reviews(spark):
    long = "word " * 20
    assert tuple(one(spark, review.accepted(F.col("a"), F.col("b")), a=long, b=long + "x"))[1:] == (True, None)
    assert one(spark, review.accepted(F.col("a"), F.col("b")), a=long, b="short").reason == "too_short"
    q = one(spark, review.quality_check(F.col("t")), t="hm\nQC_SCORE=87\nNEED_RERUN=yes\nSUGGEST_OCR_QUALITY=High\nSUGGEST_GENERATE_PAGE_IMAGES=1")
    assert tuple(q)[:5] == (87, True, "high", "accurate", True)


class Flaky:
    def __init__(self):
        self.n = 0

    def generate(self, messages, stage):
        self.n += 1
        if self.n < 3:
            raise ValueError("no")
        return "done"


def test_model_calls(spark):
    waits = []
    assert model_calls.call(Flaky(), [], "x", tries=3, base=1.5, wait=waits.append) == ("done", None) and waits == [1.5, 3.0]
    assert model_calls.call(Flaky(), [], "x", tries=2)[1].startswith("ValueError")
    tries = model_calls.attempts(3, 0.7, True, None, [False, True])
    assert [(t.temperature, t.thinking, t.max_reasoning) for t in tries] == [(0.7, True, None), (0.2, True, 512), (0.2, False, 0)]
    body = model_calls.payload("m", [], 0.1, 5, thinking=False, max_reasoning=9, local=True)
    assert body["max_reasoning_tokens"] == 0 and body["reasoning_effort"] == "none" and body["enable_thinking"] is False
    assert model_calls.payload("m", [], None, None, thinking=True, max_reasoning=9, local=True)["max_reasoning_tokens"] == 9
    lines = F.array(*[F.lit(x) for x in ('data: {"choices":[{"delta":{"content":"a"}}]}', "data: broken", 'data: {"choices":[{"delta":{"content":"b"}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"c"}}]}')])
    assert one(spark, model_calls.streamed_text(lines), t="") == "ab"
    made = F.array(model_calls.user_message(F.col("t"), F.array(F.lit("p.png"))))
    assert "image_url" in one(spark, model_calls.openai_messages(made), t="hello")
    assert one(spark, model_calls.summary(made), t="hello") == "0:user images=1 text_chars=5"


def test_second_pass_and_captions(spark):
    md = "| a | b |\n| --- | --- |\n| 1 |\nend\n| a long header | another one |\n| --- | --- |\n| 1 | 2 |"
    pages = spark.createDataFrame([(1, md), (2, "none"), (3, None)], "page_id long, md string")
    got = {r.page_id: (r.md, r.n_patched) for r in pipeline.second_pass(pages, model_calls.EchoClient).collect()}
    assert got[1] == (md, 0) and got[2] == ("none", 0)  # the stand-in's answer keeps a ragged row ragged, so it isn't taken
    docs = pages.withColumnRenamed("page_id", "doc_id")
    got = {r.doc_id: r.md for r in pipeline.caption_tables(docs, model_calls.EchoClient).collect()}
    assert got[1].startswith(md) and "> **表格信息：** caption " in got[1] and got[2] == "none" and got[3] is None


def test_second_pass_sends_pages_pictures(spark):
    class Seen(model_calls.EchoClient):
        """Widens a ragged row, and says in its first cell how many pictures came and how long they were."""

        def generate(self, messages, stage):
            parts = messages[-1]["content"]
            assert all(p["image"] is not None for p in parts[:-1]) and parts[-1]["text"]
            seen = "+".join(p["image"][:22] + str(len(base64.b64decode(p["image"].partition(",")[2]))) for p in parts[:-1])
            return super().generate(messages, stage).replace("first", seen or "nothing")

    md = "above\n| a | b |\n| --- | --- |\n| first | |\n| | |\nend\n| a | b |\n| --- | --- |\n| first | |\n| | |"
    pages = spark.createDataFrame([(k, md) for k in range(5)] + [(9, "no table")], "page_id long, md string")
    shots = spark.createDataFrame([(0, "a.jpg", b"x" * 300), (1, None, b"y" * 50), (2, "c.png", None), (3, "d.png", b"z" * 100), (9, "n.png", b"never sent")], "page_id long, name string, content binary")
    got = {r.page_id: (r.md, r.n_patched) for r in pipeline.second_pass(pages, Seen, pictures=shots).collect()}
    told = {0: "data:image/jpeg;base64300", 1: "data:image/png;base64,50", 2: "nothing", 3: "data:image/png;base64,100", 4: "nothing"}
    assert got == {k: (md.replace("first", v), 2) for k, v in told.items()} | {9: ("no table", 0)}
    asked = spark.createDataFrame([(f"{k}/{t}", k, "text") for k in range(5) for t in range(2)], "id string, page_id long, ask string")
    parts = lambda most: pipeline.with_pictures(asked, shots, most).rdd.getNumPartitions()
    assert parts(10_000) == 1 and parts(300) == 3  # 900 bytes go out: each picture with both of its page's questions


def workbook():
    out = io.BytesIO()
    head = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", head + '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_conversion_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_text("<html><body><nav>menu</nav><h1>T</h1><p>size 2*3</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table></body></html>")
    (tmp_path / "sub/b.xlsx").write_bytes(workbook())
    (tmp_path / "c.pdf").write_bytes(b"no reader here")
    (tmp_path / "d.txt").write_text("skipped")
    got = {os.path.basename(r.path): r for r in pipeline.convert(spark, str(tmp_path), config.Settings()).collect()}
    assert set(got) == {"a.html", "b.xlsx", "c.pdf"}
    assert got["a.html"].markdown == "# a.html\n\n## 第 1 / 1 页\n\n# T\n\nsize 2\\*3\n\n| a | b |\n| --- | --- |\n| 1 |  |\n\n---\n"
    assert got["b.xlsx"].markdown == "# b\n\n## Sheet: S1\n\n| name | n |\n| --- | --- |\n|  | 7 |\n"
    assert got["c.pdf"].failed_pages == [1]
    done = spark.createDataFrame([(got["a.html"].path,)], "path string")
    assert pipeline.convert(spark, str(tmp_path), config.Settings(), done=done).count() == 2
    spark.dataSource.register(files.WorkbookSource)
    assert spark.read.format("workbook").load(str(tmp_path / "sub/b.xlsx")).count() == 2


def test_uploads_and_archives(spark):
    rows = spark.createDataFrame([("j", 1, "a", 6), ("j", 2, "b", 6), ("k", 1, " ", 1)], "job_id string, pos int, name string, length long")
    got = {(r.job_id, r.pos): r.error for r in files.upload_errors(rows, 10, "folder").collect()}
    assert got == {("j", 1): None, ("j", 2): "too_large", ("k", 1): "missing_name"}
    z = sinks.archives(spark.createDataFrame([("j", "b.md", b"2"), ("j", "a.md", b"1")], "job_id string, name string, content binary")).first()
    assert zipfile.ZipFile(io.BytesIO(z.archive)).namelist() == ["a.md", "b.md"]
    assert files.page_limit(9, None) == 9 and files.page_limit(9, 0) == 1


EVENTS = [("j1", 1, "t1", "insert"), ("j1", 2, "t2", "succeed"), ("j1", 3, "t3", "claim"), ("j1", 4, "t4", "fail"), ("j1", 5, "t5", "retry"), ("j2", 6, "t6", "insert"), ("j2", 7, "t7", "claim"), ("j2", 8, "t8", "progress"), ("j2", 9, "t9", "succeed"), ("j3", 10, "t10", "insert"), ("j3", 11, "t11", "delete"), ("j4", 12, "t12", "claim")]


def test_job_states_batch_and_stream(spark, tmp_path):
    cols = "job_id string, seq long, at string, action string"
    log = spark.createDataFrame(EVENTS, cols).selectExpr("*", "'u' AS owner_username", "'f' AS original_filename", "'e' AS error_message", "150 AS progress_percent", "'n' AS progress_note", "CAST(1 AS INT) AS progress_pages_done", "CAST(2 AS INT) AS progress_pages_total", "'{}' AS result_extra")
    got = {r.job_id: r for r in jobs.latest_state(log).collect()}
    assert set(got) == {"j1", "j2"}
    assert (got["j1"].status, got["j1"].attempt_count, got["j1"].created_at, got["j1"].error_message) == ("queued", 1, "t5", None)
    assert (got["j2"].status, got["j2"].progress_percent, got["j2"].finished_at) == ("succeeded", 100, "t9")
    with queue.rocksdb(spark):
        for part in (EVENTS[:4], EVENTS[4:]):  # the second run takes up from the checkpoint of the first
            spark.createDataFrame([(a, b, d) for a, b, _, d in part], "job_id string, seq long, action string").write.mode("append").parquet(str(tmp_path / "in"))
            stream = queue.incoming(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
            queue.work(queue.job_states(stream), queue.keep(str(tmp_path / "states")), str(tmp_path / "cp"), mode="update").awaitTermination()
    out = queue.latest(spark, str(tmp_path / "states")).collect()
    assert {r.job_id: (r.status, r.attempt_count) for r in out} == {"j1": ("queued", 1), "j2": ("succeeded", 1), "j3": ("queued", 0)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none").rpartition(".")[2] != "RocksDBStateStoreProvider"
    seen = []
    queue.work(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination()
    assert seen == [len(EVENTS)]


def test_job_ids_and_paths(spark):
    assert one(spark, jobs.valid_id(F.col("t")), t=" " + "a1" * 16 + " ") == "a1" * 16 and one(spark, jobs.valid_id(F.col("t")), t="A1" * 16) is None
    assert one(spark, jobs.safe_path(F.col("t")), t="/a\\b/") == "a/b" and one(spark, jobs.safe_path(F.col("t")), t="a/../b") is None


def test_image_resolution(spark):
    refs = spark.createDataFrame([(1, 0, "http://x/a.png", "/d"), (1, 1, "img/b.png", "/d/"), (1, 2, "gone.png", "/d"), (1, 3, "/e/c.png", "/d"), (2, 0, "file:///x.png", "/d")], "doc_id int, pos int, ref string, folder string")
    there = spark.createDataFrame([("/d/img/b.png",), ("/e/c.png",)], "path string")
    got = sorted((r.doc_id, r.n, r.resolved) for r in images.resolve(refs, there, 3).collect())
    assert got == [(1, 1, "http://x/a.png"), (1, 2, "/d/img/b.png"), (1, 3, "/e/c.png"), (2, 1, "/x.png")]
    found = spark.createDataFrame([("/d", "/p/a.png"), ("/d", "/q/a.png"), ("/d", "/q/b.png")], "doc_dir string, path string")
    assert sorted(r.target for r in images.copied_names(found).collect()) == ["images/a-2.png", "images/a.png", "images/b.png"]


@pytest.mark.parametrize(("raw", "want"), [("```\nx\n```", "x"), ("```md\n```", "```md\n```"), (" y ", "y"), (None, "")])
def test_fences(spark, raw, want):
    assert one(spark, text.strip_fence(F.col("t")), t=raw) == want


def test_entry_module_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": ""})
    # every other module imports, and every other test is found
    code = "import importlib, pkgutil, foliant; [importlib.import_module(m.name) for m in pkgutil.walk_packages(foliant.__path__, 'foliant.')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": ""})
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert found.returncode == 0 and "llm" not in found.stdout
