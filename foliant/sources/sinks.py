"""Writing results: assembled documents, mirrored paths, incremental runs, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import folder_name

FAILED_PAGE = "（本页转写未成功）"


def mirrored(relative: Column) -> Column:
    """Where a source's Markdown goes; the source's own path stays the row's key, so equal names don't collide."""
    return F.concat(F.regexp_replace(relative, r"(?<=[^/])\.[^./]+$", ""), F.lit(".md"))


def pending(files: DataFrame, outputs: DataFrame, key: str = "path") -> DataFrame:
    """Files that have no output yet."""
    return files.join(outputs.select(key).distinct(), key, "left_anti")


def with_model_dir(rows: DataFrame, model: Column) -> DataFrame:
    return rows.withColumn("model_dir", folder_name(model))


def completed(pages: DataFrame) -> DataFrame:
    """pages (path, page_no, body, failed) up to each document's last page, with the holes filled in as failed ones."""
    last = pages.groupBy("path").agg(F.max("page_no").alias("last"))
    every = last.select("path", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page_no"))
    joined = every.join(pages, ["path", "page_no"], "left")
    return joined.select("path", "page_no", "body", F.coalesce("failed", F.lit(True)).alias("failed"))


def assemble(pages: DataFrame, name: Column | None = None) -> DataFrame:
    """(path, markdown, n_pages, failed_pages): each document's pages in order, under their headings."""
    body = F.when(F.col("failed") | F.col("body").isNull(), FAILED_PAGE).otherwise(F.regexp_replace("body", r"(?U)\s+\z", ""))
    page = F.struct("page_no", body.alias("body"))
    bad = F.sort_array(F.collect_set(F.when(F.col("failed"), F.col("page_no"))))
    docs = pages.groupBy("path").agg(F.array_sort(F.collect_list(page)).alias("p"), bad.alias("failed_pages"))  # one document's pages
    one = lambda x: F.concat(F.lit("## 第 "), x["page_no"].cast("string"), F.lit(" / "), F.size("p").cast("string"), F.lit(" 页\n\n"), x["body"], F.lit("\n\n---"))
    title = F.regexp_extract("path", r"([^/]*)$", 1) if name is None else name
    text = F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform("p", one), "\n\n"), F.lit("\n"))
    return docs.select("path", text.alias("markdown"), F.size("p").alias("n_pages"), "failed_pages")


def write(docs: DataFrame, root: str, mode: str = "append") -> None:
    """Documents as Parquet by model folder: many small files would not scale."""
    docs.write.mode(mode).partitionBy("model_dir").parquet(root)


def archives(files: DataFrame) -> DataFrame:
    """files (job_id, name, content) as (job_id, archive): a ZIP file of each job's files, which is one value and so fits in a task."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(f["name"], f["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(name), content)
        return pd.DataFrame({"job_id": [f["job_id"].iloc[0]], "archive": [out.getvalue()]})

    return files.select("job_id", "name", "content").groupBy("job_id").applyInPandas(run, "job_id string, archive binary")


def budgeted(rows: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key (0: all)."""
    if most <= 0:
        return rows
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", rank).where(F.col("__n") <= most).drop("__n")


def missing_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (path) to files that don't exist."""
    return refs.join(files.select("path").distinct(), "path", "left_anti")


def splice(parts: Iterable[str], at: int, to: int, new: Iterable[str]) -> list[str]:
    parts = list(parts)
    return [*parts[:at], *new, *parts[to + 1 :]]
