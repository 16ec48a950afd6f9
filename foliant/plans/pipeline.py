"""From files to Markdown: scan, extract, normalise, review suspicious tables, caption, assemble."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.functions.text import data_url, escape_dimensions, join_lines, let, lines, strip_fence
from foliant.operators import images, model_calls, tables
from foliant.plans import refine
from foliant.sources import files, sinks


#: Bytes of pictures that one task sends to a model, a single page's apart.
TASK_BYTES = 64 << 20


def second_pass(pages: DataFrame, make: Callable[[], model_calls.ModelClient], most: int = 0, pictures: DataFrame | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """pages (page_id, md) with suspicious tables rewritten by a model, and n_patched.

    A rewrite counts if rows, columns and lines stay; the first `most` (0: all) that count are put in place. pictures
    (page_id, name, content): a page's own picture goes with each question about it, in the form its name tells; a page
    without one is asked about by its text alone. Only pictures of pages with a suspicious table are moved, and tasks
    are as many as it takes for each to hold about `task_bytes` of them.
    """
    found = pages.select("page_id", lines(F.col("md")).alias("l"), F.posexplode(tables.blocks(F.col("md"))).alias("k", "b"))
    odd = found.where(tables.is_suspicious(F.col("b.markdown")))
    before = join_lines(F.slice("l", F.greatest(F.lit(1), F.col("b.start_line") - 1), F.least(F.lit(2), F.col("b.start_line"))))
    ask = model_calls.prompt(model_calls.TASKS["table_cleanup"], ("Context", before), ("Table", F.col("b.markdown")))
    key = F.struct(F.col("page_id").cast("string").alias("p"), F.col("k").alias("k"))
    asked = odd.select(F.to_json(key).alias("id"), "page_id", "k", "b", ask.alias("ask"))
    if pictures is None:
        shown = asked.select("id", F.array(model_calls.message("user", model_calls.text_part(F.col("ask")))).alias("messages"))
    else:
        shown = with_pictures(asked, pictures, task_bytes)
    answers = model_calls.run(shown, make, "table_cleanup")
    # one value, so that the rewrite isn't written out again wherever it is looked at
    judged = lambda new: F.struct(
        new.alias("new"), tables.invariants(F.col("b.markdown"), new)["ok"].alias("ok"), F.size(lines(new)).alias("n_lines")
    )
    # a generator's output is computed once, whatever looks at it
    fits = asked.join(answers, "id").select("*", F.explode(F.array(let(tables.first_block(strip_fence(F.col("answer"))), judged))).alias("v"))
    fits = fits.where(F.col("v.ok") & (F.col("v.n_lines") == F.col("b.end_line") - F.col("b.start_line") + 1)).withColumn("new", F.col("v.new"))
    kept = sinks.budgeted(fits.select("page_id", "k", "b", "new"), ["page_id"], ["k"], most)
    patch = F.struct("b.start_line", F.struct(F.col("b.end_line").alias("end_line"), lines(F.col("new")).alias("new")))
    patches = kept.groupBy("page_id").agg(F.map_from_entries(F.collect_list(patch)).alias("patches"))  # one page's tables
    rows = pages.select("page_id", "md").join(patches, "page_id", "left")
    md = F.when(F.col("patches").isNull(), join_lines(lines(F.col("md")))).otherwise(refine.with_patches(F.col("md"), F.col("patches")))
    return rows.select("page_id", md.alias("md"), F.coalesce(F.size("patches"), F.lit(0)).alias("n_patched"))


def with_pictures(asked: DataFrame, pictures: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """asked (id, page_id, ask) as (id, messages), a page's picture before its question; dealt by the pictures' bytes."""
    wanted = pictures.join(asked.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "name", "content")
    sized = asked.select("id", "page_id", "ask").join(wanted, "page_id", "left")
    total = sized.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    url = F.when(F.col("content").isNotNull(), data_url(F.coalesce("name", F.lit("")), F.col("content")))
    shown = F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array(url))
    dealt = sized.repartition(max(1, -(-total // task_bytes)), "id")
    return dealt.select("id", F.array(model_calls.user_message(F.col("ask"), shown)).alias("messages"))


def caption_tables(docs: DataFrame, make: Callable[[], model_calls.ModelClient], around: int = 2, longest: int = 120, most: int = 0) -> DataFrame:
    """docs (doc_id, md) with a caption after each table that is worth one."""
    found = docs.select("doc_id", lines(F.col("md")).alias("l"), F.posexplode(tables.blocks(F.col("md"))).alias("k", "b")).where(tables.is_caption_worthy(F.col("b.markdown")))
    context = images.table_context(F.col("l"), F.col("b.start_line"), F.col("b.end_line"), around)
    ask = model_calls.prompt(model_calls.TASKS["table_caption"], ("Context", context), ("Table", F.col("b.markdown")))
    asked = found.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("id"), "doc_id", "k", "b.end_line", F.array(model_calls.message("user", model_calls.text_part(ask))).alias("messages"))
    got = asked.join(model_calls.run(asked, make, "table_caption"), "id").withColumn("caption", images.clean_caption(F.col("answer"), longest)).where("caption <> ''")
    kept = sinks.budgeted(got.select("doc_id", "k", "end_line", "caption"), ["doc_id"], ["k"], most)
    per_doc = kept.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("end_line", "caption"))).alias("captions"))  # one document's tables
    joined = docs.join(per_doc, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("captions").isNull(), F.col("md")).otherwise(images.with_captions(F.col("md"), F.col("captions"), "表格信息")).alias("md"))


def convert(spark: SparkSession, root: str, settings: Settings, extract: files.Extractor = files.standard_extractor, done: DataFrame | None = None, page: Callable[[str], str] | None = None) -> DataFrame:
    """(path, markdown, n_pages, failed_pages) of the supported files below a folder that have no output yet.

    page: a last change to each page's body, run on the executors.
    """
    allowed = [f".{t}" for t in settings.allowed_types]
    found = files.scan(spark, root, allowed, settings.max_files)
    found = found if done is None else sinks.pending(found, done)
    paged = files.pages(found.where(files.route(F.col("path")) != "workbook"), extract, settings.max_pages)
    paged = paged.withColumn("body", escape_dimensions(tables.normalize(F.col("body"))))
    if page is not None:
        paged = paged.withColumn("body", F.pandas_udf(lambda s: s.map(page, na_action="ignore"), "string")("body"))
    docs = sinks.assemble(sinks.completed(paged))
    sheets = files.workbooks(found.where(files.route(F.col("path")) == "workbook"))
    return docs.unionByName(workbook_documents(sheets))


def workbook_documents(rows: DataFrame) -> DataFrame:
    """Workbook rows as documents: a heading and a pipe table for each sheet."""
    sheet = rows.groupBy("path", "sheet", "sheet_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r"))  # one sheet
    width = F.size(F.get("r", F.lit(0))["cells"])
    line = lambda x: tables.format_row(tables.fitted_row(x["cells"], width))
    all_lines = F.transform("r", line)
    rule = tables.format_row(F.array_repeat(F.lit("---"), width))
    table = F.array_join(F.concat(F.slice(all_lines, 1, 1), F.array(rule), F.slice(all_lines, 2, 1 << 30)), "\n")
    one = sheet.select("path", F.struct("sheet_no", F.col("sheet").alias("name"), table.alias("markdown")).alias("s"))
    docs = one.groupBy("path").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = tables.join_sheets(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", ""), F.col("s"))
    return docs.select("path", text.alias("markdown"), F.size("s").alias("n_pages"), F.array().cast("array<int>").alias("failed_pages"))
