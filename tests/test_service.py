import io
import json
import sys
import threading
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliant import cli, config, logs, model, web
from foliant.operators import crops, images, model_calls, model_http
from foliant.plans import refine, service
from foliant.sources import files


#: Workers can't import this file: its classes travel with what uses them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A model over HTTP


class Server:
    """Answers of a model, one after another; exceptions are raised."""

    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def __call__(self, url, body, headers, timeout):
        self.seen.append((url, json.loads(json.dumps(body)), headers, timeout))
        got = self.answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got if isinstance(got, list) else [json.dumps(got).encode()]


def chat(content, **more):
    return {"id": "r1", "choices": [{"message": {"content": content, **more}}]}


ASK = [{"role": "user", "content": [{"type": "text", "text": "hi", "image": None}]}]


def test_empty_answers_are_asked_again_with_less_thinking():
    server = Server(chat(" "), chat(None, reasoning_content="hm"), chat([{"type": "text", "text": "do"}, {"text": "ne"}]))
    client = model_http.HttpModel("http://h/compatible-mode/v1/", "m", "key", temperature=0.7, thinking=True, send=server)
    assert client.generate(ASK, "page") == "done"
    bodies = [b for _, b, _, _ in server.seen]
    assert [(b["temperature"], b["enable_thinking"], b.get("max_reasoning_tokens")) for b in bodies] == [(0.7, True, None), (0.2, True, 512), (0.2, False, 0)]
    assert server.seen[0][0] == "http://h/compatible-mode/v1/chat/completions" and server.seen[0][2]["Authorization"] == "Bearer key"
    texts = [b["messages"][0]["content"][0]["text"] for b in bodies]
    assert model_calls.GUARD in texts[0] and model_calls.CONCISE_GUARD not in texts[0] and texts[1].endswith(model_calls.CONCISE_GUARD)


def test_failed_requests_wait_twice_as_long_each_time():
    waits, server = [], Server(OSError("a"), OSError("b"), {"output": {"choices": [{"message": {"content": [{"text": "x"}, {"text": "y"}]}}]}})
    client = model_http.HttpModel("https://dashscope.x/api/v1", "m", send=server, wait=waits.append)
    assert client.generate(ASK, "page") == "x\ny" and waits == [1.5, 3.0]
    assert server.seen[0][0].endswith(model_http.NATIVE_PATH) and server.seen[0][1]["input"]["messages"] == [{"role": "user", "content": [{"text": "hi"}]}]
    with pytest.raises(OSError, match="c"):
        model_http.HttpModel("http://h/v1", "m", send=Server(OSError("c")), retries=1).generate(ASK, "page")
    with pytest.raises(RuntimeError):
        model_http.HttpModel("http://h/v1", "m", send=Server(chat(""), chat("")), empty_tries=2).generate(ASK, "page")


def test_streamed_answers_and_timeouts():
    lines = [b'data: {"id":"q","choices":[{"delta":{"content":"a","thinking":"t"}}]}', b"", b"data: no", b'data: {"choices":[{"delta":{"content":[{"type":"text","text":"b"}]}}]}', b"data: [DONE]", b'data: {"choices":[{"delta":{"content":"c"}}]}']
    client = model_http.from_settings(config.Settings(), "http://h:11434/v1", "m", send=Server(lines), stream=True)()
    assert client.generate(ASK, "page") == "ab"
    assert client.send.seen[0][1]["reasoning_effort"] == "none" and client.send.seen[0][3] == model_http.Timeout(120.0, 300.0)
    assert model_http.Timeout.of(3) == model_http.Timeout(30.0, 30.0)


def test_stand_ins_that_know_no_stage(tmp_path):
    class Old:
        def generate(self, messages):
            return "old"

    assert model_calls.call(Old(), ASK, "x") == ("old", None)
    (tmp_path / "a.jpg").write_bytes(b"123")
    assert model_http.image_url(str(tmp_path / "a.jpg")) == "data:image/jpeg;base64,MTIz" and model_http.image_url("http://x/y") == "http://x/y"


def test_pages_are_transcribed_again_while_they_are_empty():
    class Some:
        def __init__(self, *answers):
            self.answers = list(answers)

        def generate(self, messages, stage):
            got = self.answers.pop(0)
            if isinstance(got, Exception):
                raise got
            return got

    waits = []
    assert refine.transcribe(Some("", "```md\n```", "```md\n# x\n```"), "d.pdf", 1, 2, "i", wait=waits.append) == ("```md\n```", False) and waits == [1.5]
    assert refine.transcribe(Some("", " ", ""), "d.pdf", 1, 2, "i", wait=waits.append) == (refine.EMPTY_PAGE, False)
    assert refine.transcribe(Some(ValueError()), "d.pdf", 1, 2, "i") == ("（本页转写未成功）", True)
    assert refine.transcribe(Some("x"), "d.pdf", 1, 2, "i", cancelled=lambda: True) == (refine.CANCELLED_PAGE, False)


class Upper:
    """A model that answers with the table in capitals, and loses a column of those that say so."""

    def generate(self, messages, stage):
        said = messages[-1]["content"][-1]["text"]
        if stage == "quality":
            return "QC_SCORE=50\nNEED_RERUN=yes\nSUGGEST_OCR_QUALITY=high" if "poor" in said else "QC_SCORE=90"
        body = said.rpartition("\n\n## ")[2].partition("\n")[2]
        pictures = sum(p["image"] is not None for p in messages[-1]["content"])
        return body.upper().replace("X ", f"X{pictures}") if "lose" not in body else body.replace(" lose |", "")


def test_tables_are_refined_with_the_images_nearest_to_them(spark):
    md = "![p](a.png)\n| x  | b |\n|---|---|\n| c | d |\nmid\n![q](b.png)\n| e | lose |\n|---|---|\n| g | h |\n"
    docs = spark.createDataFrame([(1, md, "/d"), (2, "none", "/d"), (3, None, "/d")], "doc_id int, md string, folder string")
    got = {r.doc_id: (r.md, r.n_refined) for r in refine.refine_tables(docs, Upper).collect()}
    assert got[1] == (md.replace("| x  | b |", "| X2 | B |").replace("| c | d |", "| C | D |").rstrip("\n"), 1) and got[2] == ("none", 0) and got[3] == (None, 0)
    there = spark.createDataFrame([("/d/a.png",)], "path string")
    assert {r.doc_id: r.md for r in refine.refine_tables(docs, Upper, there, most=1).collect()}[1].startswith("![p](a.png)\n| X1 | B |")


def test_documents_are_converted_again_where_a_check_asks_for_it(spark, tmp_path):
    rows = spark.createDataFrame([(1, "fine"), (2, "poor")], "doc_id int, src string")
    asked = []

    def convert(some, settings):
        asked.append(settings.ocr_quality)
        return some.select("doc_id", F.concat("src", F.lit(f" {settings.ocr_quality}")).alias("md"))

    def check(md):
        return refine.quality_answers(md.select("doc_id", F.col("md").alias("before"), F.col("md").alias("after")), Upper)

    def save(df):
        at = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(at)
        return spark.read.parquet(at)

    got = {r.doc_id: r.md for r in refine.converted(rows, convert, config.Settings(), check, save).collect()}
    assert got == {1: "fine balanced", 2: "poor high"} and asked == ["balanced", "high"]


# Crops


def drawn(width, height, *boxes):
    page = np.full((height, width, 3), 255, dtype=np.uint8)
    for x0, y0, x1, y1 in boxes:
        page[y0:y1, x0:x1] = 0
    return page


def test_regions_hang_together_over_small_gaps():
    page = drawn(1000, 800, (50, 50, 300, 250), (301, 50, 400, 250), (600, 500, 900, 700), (10, 760, 990, 770), (5, 5, 15, 15))[:, :, 0]
    assert crops.regions(page) == [(50, 50, 400, 250), (600, 500, 900, 700)]
    assert crops.regions(np.full((50, 60), 255, dtype=np.uint8)) == []
    ring = drawn(200, 200, (20, 20, 180, 180))[:, :, 0]
    ring[40:160, 40:160] = 255
    assert crops.regions(ring) == [(20, 20, 180, 180)]


def test_crop_plan_takes_the_best_source_that_a_page_has(spark):
    kind = f"array<{model.BOX}>"
    box = lambda *b: tuple(map(float, b))
    pages = [
        (1, ["左上", "右下"], [box(300, 250, 450, 380)], [box(50, 50, 250, 150)], [], 500.0, 400.0),
        (2, ["左上"], [], [box(10, 10, 490, 395)], [box(100, 100, 400, 300)], 500.0, 400.0),
        (3, [None], [], [], [], 500.0, 400.0),
    ]
    df = spark.createDataFrame(pages, f"page_id long, positions array<string>, layout {kind}, embedded {kind}, regions {kind}, page_width double, page_height double")
    got = {(r.page_id, r.k): (r.source, r.x0, r.y0, r.x1, r.y1) for r in crops.crop_plan(df, 1000, 800).collect()}
    assert got[1, 0] == ("boxes", 590, 490, 910, 770) and (1, 1) not in got
    assert got[2, 0] == ("regions", 100, 100, 400, 300)
    assert got[3, 0] == ("positions", 20, 16, 980, 784)


def test_pictures_are_cut_trimmed_and_named(spark):
    page = drawn(200, 160, (30, 30, 120, 100))
    image = (160, 200, 3, page.tobytes())
    images_ = spark.createDataFrame([(1, image)], "page_id long, image struct<height:int,width:int,nChannels:int,data:binary>")
    plan = spark.createDataFrame([(1, 7, 0, 20.0, 20.0, 140.0, 120.0), (1, 7, 1, 0.0, 0.0, 10.0, 160.0)], "page_id long, page_no int, k int, x0 double, y0 double, x1 double, y1 double")
    got = crops.pictures(plan, images_).collect()
    assert [(r.k, r.name) for r in got] == [(0, "page_0007_fig_01.png")] and got[0].content.startswith(b"\x89PNG")


def test_locators_that_fail_find_nothing(spark):
    pages = spark.createDataFrame([(1, "a.pdf", b"x", 0, 100.0, 100.0)], "page_id long, path string, content binary, page_index int, page_width double, page_height double")

    def broken(path, content, index):
        raise ValueError

    got = crops.located(pages, lambda p, c, i: [(0, 0, 95, 100), (0, 0, 50, 50)], broken).first()
    assert [tuple(b) for b in got.layout] == [(0, 0, 50, 50)] and got.embedded == []


# Small rules


def test_uploads_are_checked_and_cleaned_up(tmp_path):
    at = service.workspace(tmp_path / "in", tmp_path / "out", "up\\Photo.PNG")
    assert at.input_entry.name == "Photo.pdf" and at.output_entry.name == "Photo.md" and len(at.job_id) == 32
    for uploads, kind, why in [([("a.md", [b"12345"])], "file", "size"), ([("d/a.md", [b"123"]), ("d/b.md", [b"123"])], "folder", "size"), ([("../a.md", [b"1"])], "folder", "path"), ([("a.exe", [b"1"])], "file", "type"), ([], "file", "empty")]:
        with pytest.raises(ValueError, match=why):
            service.ingest(at, uploads, kind, 4, ["md"])
        assert not at.input_root.exists()
    assert [p.read_bytes() for p in service.ingest(at, [("d/a.md", [b"12", b"3"])], "folder", 4, ["md"])] == [b"123"]
    assert zipfile.ZipFile(io.BytesIO(service.zipped(at.input_root))).namelist() == ["d/a.md"]


def test_images_and_languages(spark):
    assert list(files.standard_extractor("x/a.png", b"\x89PNG..")) == [("![a](images/a.png)", False)] and list(files.standard_extractor("a.png", b"?")) == [("（图片读取失败）", True)]
    docs = spark.createDataFrame([(1, "/d/", "![a.png](./x/../a.png) ![](/o/a.png \"t\") ![](/p/a.png) ![](gone.png) ![](http://h/a.png)")], "doc_id int, doc_dir string, md string")
    there = spark.createDataFrame([("/d/a.png",), ("/o/a.png",), ("/p/a.png",), ("/d/images/a.png",)], "path string")
    md, copies = images.rewrite_refs(docs, there)
    assert md.first()[1:] == ("![a.png](a.png) ![](images/a-2.png \"t\") ![](images/a-3.png) ![](gone.png) ![](http://h/a.png)", 3)
    assert {tuple(r) for r in copies.collect()} == {("/o/a.png", "/d/images/a-2.png"), ("/p/a.png", "/d/images/a-3.png")}
    assert config.database_kind(None) == "sqlite" and config.database_kind(" MySQL ") == "mysql"
    with pytest.raises(ValueError):
        config.database_kind("other")


def test_command_line(spark, tmp_path):
    for wrong in (["--page-workers", "0"], ["--ocr-confidence", "1.5"], ["--ocr-bitmap-threshold", "0"], ["--scan-max-scale", "3"], ["--second-pass-max-tables", "-1"], ["--empty-content-retries", "11"]):
        assert cli.main(["in", "out", *wrong], spark) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<h1>T</h1>")
    args = [str(tmp_path / "in"), str(tmp_path / "out")]
    assert cli.main(args, spark) == 0
    (tmp_path / "in/b.pdf").write_bytes(b"no reader")
    assert cli.main([*args, "--skip-existing"], spark) == 1
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.target for r in rows.collect()) == ["a.md", "b.md"]


def test_logs(tmp_path):
    assert logs.key_values(a=None, b=True, c="x\ny") == "a=- b=true c=x\\ny"
    kinds = [type(logs.file_handler(tmp_path / "l/x.log", **k)).__name__ for k in ({}, {"mode": "time"}, {"most_bytes": 0})]
    assert kinds == ["RotatingFileHandler", "TimedRotatingFileHandler", "FileHandler"]
    record = lambda m: logs.logging.LogRecord("a", 20, "f", 1, m, (), None)
    keep = logs.WithoutPolling().filter
    assert keep(record('"GET /health HTTP/1.1"')) and not keep(record('"GET /jobs?page=1 HTTP')) and not keep(record(f'"GET /jobs/{"a" * 32} HTTP/1.1"'))


# The service


def test_a_job_from_upload_to_download(spark, tmp_path):
    store = service.JobStore(spark, str(tmp_path / "store"))
    store.bootstrap(["ann", "bob "], "secret", "root")
    store.bootstrap(["ann"], "other", "root")
    assert {r.username: r.role for r in store.users().collect()} == {"ann": "user", "bob": "user", "root": "admin"} and store.authenticate("ann", "secret") and not store.authenticate("ann", "other")
    store.ensure_admin("root", "new")
    assert store.authenticate("root", "new")

    def work(job, hooks):
        if job.original_filename == "bad.html":
            raise ValueError("no good")
        hooks.progress(1, 2)
        (tmp_path / "out" / job.job_id).mkdir(parents=True)
        (tmp_path / "out" / job.job_id / "a.md").write_text("# T")
        return {"result_extra": "{}"}

    runner = service.Runner(spark, store, work)
    app = web.App(store, runner, replace(config.Settings(), max_file_size=100), tmp_path / "in", tmp_path / "out", "s3")
    ask = lambda method, path, who=None, **k: app.handle(web.Request(method, path, headers={"Authorization": f"Bearer {who}"} if who else {}, **k))
    assert ask("GET", "/health") == (200, {"status": "ok"}) and ask("GET", "/nowhere")[0] == 404 and ask("GET", "/auth/me")[0] == 401 and ask("GET", "/auth/me", "x.y.z")[0] == 401
    login = lambda name, word: ask("POST", "/auth/login", body=json.dumps({"username": name, "password": word}).encode())
    assert login("ann", "wrong")[0] == 401
    ann, bob = (login(n, "secret")[1]["access_token"] for n in ("ann", "bob"))
    assert ask("GET", "/auth/me", ann)[1] == {"username": "ann", "role": "user"} and ask("GET", "/auth/users", ann)[0] == 403
    assert ask("POST", "/jobs", ann, files=[("a.html", [b"x" * 101])])[0] == 413 and ask("POST", "/jobs", ann, files=[("a.exe", [b"x"])])[0] == 400
    made = [ask("POST", "/jobs", ann, files=[(n, [b"<h1>T</h1>"])])[1]["job_id"] for n in ("a.html", "bad.html", "late.html")]
    assert ask("GET", f"/jobs/{made[1]}", ann)[1]["queue_position"] == 2 and ask("GET", f"/jobs/{made[0]}", bob)[0] == 403 and ask("GET", "/jobs/zz", ann)[0] == 400
    assert ask("POST", f"/jobs/{made[2]}/cancel", ann)[0] == 200 and ask("POST", f"/jobs/{made[2]}/cancel", ann)[0] == 409
    assert runner.drain() == {made[0]: "succeeded", made[1]: "failed"}
    listed = ask("GET", "/jobs", ann, query={"page_size": "2"})[1]
    assert listed["total"] == 3 and len(listed["items"]) == 2 and listed["counts"] == {"succeeded": 1, "failed": 1, "cancelled": 1, "all": 3}
    assert store.get(made[1]).error_message == "no good" and runner.wait(made[0]).status == "succeeded"
    code, got = ask("POST", "/jobs/batch-download", ann, body=json.dumps({"job_ids": [made[0], made[0]]}).encode())
    assert code == 200 and zipfile.ZipFile(io.BytesIO(got)).namelist() == [f"a_{made[0][:8]}/a.md"] and ask("GET", f"/jobs/{made[1]}/download", ann)[0] == 400
    assert ask("POST", f"/jobs/{made[1]}/retry", ann)[0] == 200 and store.queued() == [made[1]]
    assert store.act(made[1], "claim") and not store.act(made[1], "claim") and store.recover() == 1 and store.queued() == [made[1]]
    assert ask("DELETE", f"/jobs/{made[0]}", ann)[0] == 200 and store.get(made[0]) is None and not (tmp_path / "out" / made[0]).exists()


def test_a_cancelled_job_stops_on_the_cluster(spark, tmp_path):
    class Store:
        now = "queued"

        def get(self, job_id):
            return type("J", (), {"status": self.now, "original_filename": "f", "job_id": job_id})

        def status(self, job_id):
            return self.now

        def act(self, job_id, action, **fields):
            self.now = {"claim": "running", "cancel": "cancelled", "fail": self.now, "succeed": self.now}[action]
            return True

        def progress(self, job_id, **fields):
            pass

    began = threading.Event()

    def work(job, hooks):
        began.set()
        spark.range(4, numPartitions=4).foreach(lambda _: __import__("time").sleep(60))

    runner = service.Runner(spark, Store(), work)
    thread = threading.Thread(target=runner.run_one, args=("j",))
    thread.start()
    began.wait()
    for _ in range(100):
        if spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        threading.Event().wait(0.1)
    runner.cancel("j")
    thread.join(30)
    assert not thread.is_alive()
    assert service.percent(1, 3) == 33 and service.percent(3, 3) == 98 and service.percent(5, 0) == 98
    with pytest.raises(service.Cancelled):
        runner.hooks("j").progress(1, 2)

