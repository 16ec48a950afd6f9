"""Convert a folder from the command line. Exit codes: 0 all went well, 1 a file failed, 2 an option is out of range."""

from __future__ import annotations

import argparse
import logging
import re
import sys
import uuid
from collections.abc import Sequence
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import config, logs
from foliant.plans import pipeline
from foliant.sources import sinks

log = logging.getLogger("cli")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant", description=__doc__)
    p.add_argument("input_dir")
    p.add_argument("output_dir")
    for flag in ("--skip-existing", "--low-memory", "--scan", "--no-tables", "--rich-images", "--verbose"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--max-files", type=int, default=0)
    p.add_argument("--max-num-pages", type=int)
    p.add_argument("--ocr-quality", choices=("fast", "balanced", "high"), default="balanced")
    p.add_argument("--ocr-confidence", type=float)
    p.add_argument("--ocr-bitmap-threshold", type=float)
    p.add_argument("--scan-max-scale", type=float)
    p.add_argument("--page-dpi", type=int, default=180)
    p.add_argument("--page-workers", type=int, default=10)
    p.add_argument("--second-pass-max-tables", type=int, default=0)
    p.add_argument("--empty-content-retries", type=int, default=3)
    return p


def range_errors(a: argparse.Namespace) -> list[str]:
    """The options that are out of range."""
    ranges = [
        ("ocr_confidence", lambda v: 0.0 <= v <= 1.0, "0 to 1"),
        ("ocr_bitmap_threshold", lambda v: 0.0 < v <= 1.0, "above 0, up to 1"),
        ("scan_max_scale", lambda v: 0.2 <= v <= 2.0, "0.2 to 2"),
        ("page_workers", lambda v: v >= 1, "1 or more"),
        ("second_pass_max_tables", lambda v: v >= 0, "0 (no limit) or more"),
        ("empty_content_retries", lambda v: 1 <= v <= 10, "1 to 10"),
    ]
    return [f"--{name.replace('_', '-')} must be {text}" for name, fine, text in ranges if getattr(a, name) is not None and not fine(getattr(a, name))]


def settings(a: argparse.Namespace) -> config.Settings:
    """Options over the environment; what memory forbids is taken back."""
    quality = "fast" if a.low_memory and a.ocr_quality == "high" else a.ocr_quality
    return replace(
        config.Settings.read(), low_memory=a.low_memory, scan_mode=a.scan, ocr_quality=quality, table_structure=not a.no_tables, max_pages=a.max_num_pages, max_files=a.max_files,
        page_images=a.rich_images and not a.low_memory and not a.scan, page_dpi=a.page_dpi, page_workers=a.page_workers, llm_empty_attempts=a.empty_content_retries,
    )


def counts(found: DataFrame, skipped: int) -> tuple[dict[str, int], int]:
    """({ok, failed, skipped}, exit code) of converted documents (failed_pages, n_pages)."""
    bad = F.size("failed_pages") >= F.col("n_pages")
    one = found.agg(F.count(F.when(~bad, 1)).alias("ok"), F.count(F.when(bad, 1)).alias("failed")).first()
    return {"ok": one.ok, "failed": one.failed, "skipped": skipped}, int(one.failed > 0)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logs.configure(a.verbose)
    wrong = range_errors(a)
    for text in wrong:
        log.error(text)
    if wrong:
        return 2
    spark = spark or SparkSession.builder.appName("foliant").getOrCreate()
    root = a.input_dir if "://" in a.input_dir else Path(a.input_dir).resolve().as_uri()
    out = a.output_dir if "://" in a.output_dir else Path(a.output_dir).resolve().as_uri()
    done = None
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    if a.skip_existing and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        done = spark.read.parquet(out).select("path").distinct()
    skipped = 0 if done is None else done.count()
    bare = re.sub("^file:/+", "/", root)  # Spark writes file:/ before a path
    relative = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(bare.rstrip("/")) + 2, 1 << 30)
    made = pipeline.convert(spark, root, settings(a), done=done)
    run = f"{out}/run={uuid.uuid4().hex}"
    sinks.write(made.withColumn("target", sinks.mirrored(relative)).withColumn("model_dir", F.lit("standard")), run)
    told, code = counts(spark.read.parquet(run), skipped)
    logs.log_event(log, logging.INFO, "convert.done", **told, output_dir=out)
    return code


if __name__ == "__main__":
    sys.exit(main())
