"""Work of a model on documents: transcription of pages, repair of tables and of whole documents, checks and reruns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.functions.text import join_lines, let, lines, strip_fence
from foliant.operators import images, model_calls, review, tables
from foliant.sources import sinks

EMPTY_PAGE, CANCELLED_PAGE = "（本页模型输出为空）", "（已取消）\n"
TRIES, PAUSE = 3, 1.5
PAGE_TASK = "Write this page down as Markdown. Page {k} of {n} of {name}."


def plain_fence(text: str) -> str:
    """functions.text.strip_fence() for one answer."""
    t = (text or "").strip()
    if not t.startswith("```"):
        return t
    inner = t.partition("\n")[2].strip().removesuffix("```").strip()
    return inner or t


def transcribe(client: model_calls.ModelClient, name: str, k: int, n: int, image: str, cancelled: Callable[[], bool] = lambda: False, wait: Callable[[float], None] = time.sleep) -> tuple[str, bool]:
    """(body, failed) of one page: asked again while the answer is empty, a little later each time."""
    part = {"type": "text", "text": PAGE_TASK.format(k=k, n=n, name=name), "image": None}
    message = {"role": "user", "content": [{"type": "image", "text": None, "image": image}, part]}
    for attempt in range(1, TRIES + 1):
        if cancelled():
            return CANCELLED_PAGE, False
        try:
            body = plain_fence(model_calls.generate(client, [message], "page"))
        except Exception:  # noqa: BLE001  whatever a client raises fails the page, not the document
            return sinks.FAILED_PAGE, True
        if body:
            return body, False
        if attempt < TRIES:
            wait(PAUSE * attempt)
    return EMPTY_PAGE, False


def transcribed(pages: DataFrame, make: Callable[[], model_calls.ModelClient], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """pages (path, page_no, n_pages, image) as (path, page_no, body, failed). Save the result before reading it twice."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        client = make()
        for f in frames:
            got = [transcribe(client, p.rpartition("/")[2], k, n, i, wait=wait) for p, k, n, i in zip(f["path"], f["page_no"], f["n_pages"], f["image"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "page_no": f["page_no"], "body": [b for b, _ in got], "failed": [x for _, x in got]})

    return pages.select("path", "page_no", "n_pages", "image").mapInPandas(run, "path string, page_no int, body string, failed boolean")


def refine_tables(docs: DataFrame, make: Callable[[], model_calls.ModelClient], files: DataFrame | None = None, around: int = 2, most_images: int = 2, most: int = 0) -> DataFrame:
    """docs (doc_id, md[, folder]) with each table as a model repairs it, and n_refined.

    The first `most` tables of a document (0: all) are asked about, with the lines before them and the images nearest
    to them: with files (path) those that exist below the document's folder, without it the references as they
    are. A rewrite that loses rows, columns or lines leaves the table as it was.
    """
    found = docs.select("doc_id", lines(F.col("md")).alias("l"), F.posexplode(tables.blocks(F.col("md"))).alias("k", "b"))
    found = sinks.budgeted(found, ["doc_id"], ["k"], most).where(tables.column_count(F.col("b.markdown")) > 0)
    refs = docs.select("doc_id", F.explode(images.refs_by_line(F.col("md"))).alias("r")).select("doc_id", "r.line_no", "r.path")
    near = images.nearest(found.select("doc_id", F.col("b.start_line").alias("start_line")), refs, most_images)
    if files is not None:
        at = near.join(docs.select("doc_id", "folder"), "doc_id").select(F.struct("doc_id", "start_line").alias("doc_id"), F.col("n").alias("pos"), F.col("path").alias("ref"), "folder")
        near = images.resolve(at, files, most_images).select("doc_id.doc_id", "doc_id.start_line", "n", F.col("resolved").alias("path"))
    near = near.groupBy("doc_id", "start_line").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("pictures"))  # few a table
    before = join_lines(F.slice("l", F.greatest(F.lit(1), F.col("b.start_line") - around + 1), F.least(F.lit(around), F.col("b.start_line"))))
    ask = model_calls.prompt(model_calls.TASKS["table_cleanup"], ("Context", before), ("Table", F.col("b.markdown")))
    asked = found.withColumn("start_line", F.col("b.start_line")).join(near, ["doc_id", "start_line"], "left")
    pictures = F.coalesce("pictures", F.array().cast("array<string>"))
    key = F.to_json(F.struct(F.col("doc_id").cast("string").alias("d"), "k"))
    asked = asked.select(key.alias("id"), "doc_id", "k", "b", F.array(model_calls.user_message(ask, pictures)).alias("messages"))
    judged = lambda new: F.struct(new.alias("new"), tables.invariants(F.col("b.markdown"), new)["ok"].alias("ok"), F.size(lines(new)).alias("n"))
    verdict = let(tables.first_block(strip_fence(F.col("answer"))), judged)
    got = asked.join(model_calls.run(asked, make, "table_cleanup"), "id").select("*", F.explode(F.array(verdict)).alias("v"))
    fits = got.where(F.col("v.ok") & (F.col("v.n") == F.col("b.end_line") - F.col("b.start_line") + 1))
    patch = F.struct("b.start_line", F.struct(F.col("b.end_line").alias("end_line"), lines(F.col("v.new")).alias("new")))
    patches = fits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(patch)).alias("patches"))  # one document's tables
    joined = docs.join(patches, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("patches").isNull(), F.col("md")).otherwise(with_patches(F.col("md"), F.col("patches"))).alias("md"), F.coalesce(F.size("patches"), F.lit(0)).alias("n_refined"))


def with_patches(markdown: Column, patches: Column) -> Column:
    """`markdown` with runs of lines replaced. patches: map<first line, struct<end_line, new>>, runs apart from one another."""
    covered = F.flatten(F.transform(F.map_entries(patches), lambda e: F.sequence(e["key"], e["value"]["end_line"])))
    none = F.array().cast("array<string>")

    def put(rows: Column, gone: Column) -> Column:
        one = lambda x, i: F.when(F.array_contains(gone, i.cast("int")), F.coalesce(F.try_element_at(patches, i.cast("int"))["new"], none)).otherwise(F.array(x))
        return F.flatten(F.transform(rows, one))

    return join_lines(let(F.struct(lines(markdown).alias("l"), covered.alias("c")), lambda v: put(v["l"], v["c"])))


def refine_documents(docs: DataFrame, make: Callable[[], model_calls.ModelClient], most_images: int = 6) -> DataFrame:
    """docs (doc_id, md) with the version that stands after a model's repair, and why: (doc_id, md, ok, reason)."""
    pictures = F.slice(images.refs(F.col("md")), 1, most_images)
    ask = model_calls.prompt(model_calls.TASKS["cleanup"], ("Document", F.col("md")))
    asked = docs.select(F.col("doc_id").cast("string").alias("id"), "doc_id", "md", F.array(model_calls.user_message(ask, pictures)).alias("messages"))
    got = asked.join(model_calls.run(asked, make, "cleanup"), "id")
    return got.select("doc_id", review.accepted(F.col("md"), strip_fence(F.col("answer"))).alias("v")).select("doc_id", F.col("v.text").alias("md"), "v.ok", "v.reason")


def quality_answers(pairs: DataFrame, make: Callable[[], model_calls.ModelClient]) -> DataFrame:
    """pairs (doc_id, before, after): what a model says of both versions, as fields of QUALITY_CHECK."""
    counts = lambda c: F.to_json(review.summary(F.col(c)))
    ask = model_calls.prompt(model_calls.TASKS["quality"], ("Counts before", counts("before")), ("Counts after", counts("after")), ("Before", F.col("before")), ("After", F.col("after")))
    asked = pairs.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.array(model_calls.message("user", model_calls.text_part(ask))).alias("messages"))
    got = asked.join(model_calls.run(asked, make, "quality"), "id")
    return got.select("doc_id", review.quality_check(F.col("answer")).alias("q")).select("doc_id", "q.*")


#: Settings that a quality check may ask for: OCR quality, table accuracy, page images.
SUGGESTIONS = [(o, t, p) for o in ("fast", "balanced", "high") for t in ("fast", "accurate") for p in (False, True)]


def converted(files: DataFrame, convert: Callable[[DataFrame, Settings], DataFrame], settings: Settings, check: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], DataFrame], most: int = 1) -> DataFrame:
    """files (doc_id, …) as convert(files, settings) gives them (doc_id, md), again with other settings where check() asks for it.

    check: (doc_id, need_rerun, ocr_quality, table_accuracy, page_images) of such a result. save: keeps a result and
    reads it back, so that nothing is converted or asked twice. A file is converted `most` times more at most;
    files that ask for the same settings are converted together.
    """
    out, left = None, files
    asked = {None: settings}
    for k in range(most + 1):
        parts = []
        for suggestion, own in asked.items():
            some = left if suggestion is None else left.where((F.col("ocr_quality") == suggestion[0]) & (F.col("table_accuracy") == suggestion[1]) & (F.col("page_images") == suggestion[2]))
            parts.append(convert(some.select(files.columns), own))
        now = parts[0]
        for p in parts[1:]:
            now = now.unionByName(p)
        now = save(now)
        if k == most:
            return now if out is None else save(out.unionByName(now))
        again = save(check(now).where("need_rerun").select("doc_id", "ocr_quality", "table_accuracy", "page_images"))
        done = now.join(again, "doc_id", "left_anti")
        out = done if out is None else out.unionByName(done)
        left = files.join(again, "doc_id")
        wanted = {tuple(r) for r in again.select("ocr_quality", "table_accuracy", "page_images").distinct().collect()}  # at most all of SUGGESTIONS
        if not wanted:
            return save(out)
        asked = {s: settings.rerun(*s) for s in SUGGESTIONS if s in wanted}
    raise AssertionError
