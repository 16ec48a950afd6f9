"""Checks of rewritten texts: plain counts, acceptance of a refined version, quality answers of a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import count_of, lines, setting, strip
from foliant.model import QUALITY_CHECK
from foliant.operators import images, tables

SHORTEST = 50


def summary(markdown: Column) -> Column:
    """struct(len_chars, image_refs, table_rows)."""
    t = F.coalesce(markdown, F.lit(""))
    rows = tables.html_rows(t) + F.size(F.filter(lines(t), lambda x: count_of(x, "|") >= 2))
    return F.struct(F.length(t).alias("len_chars"), F.size(images.refs(t)).alias("image_refs"), rows.cast("int").alias("table_rows"))


def accepted(original: Column, refined: Column) -> Column:
    """struct(text, ok, reason): the refined version, or the first one with the reason why it stays."""
    before, after = summary(original), summary(refined)
    reason = (
        F.when(strip(F.coalesce(refined, F.lit(""))) == "", "empty")
        .when(F.length(strip(refined)) < SHORTEST, "too_short")
        .when((before["table_rows"] > 0) & (after["table_rows"] == 0), "tables_lost")
        .when(~images.invariants(original, refined)["ok"], "images_changed")
    )
    return F.struct(F.when(reason.isNull(), refined).otherwise(original).alias("text"), reason.isNull().alias("ok"), reason.alias("reason"))


def quality_check(answer: Column) -> Column:
    """A model's KEY=value answer; what is missing or unknown takes the default."""
    raw = F.coalesce(answer, F.lit(""))
    score = setting(raw, "QC_SCORE")
    yes = lambda key: F.lower(F.coalesce(setting(raw, key), F.lit("no"))).isin("yes", "true", "1", "y")

    def one_of(key: str, names: tuple[str, ...], default: str) -> Column:
        got = F.lower(F.coalesce(setting(raw, key), F.lit(default)))
        return F.when(got.isin(*names), got).otherwise(default)

    return F.struct(
        F.when(score.rlike("^[0-9]+$"), score.try_cast("int")).otherwise(0).alias("score"),
        yes("NEED_RERUN").alias("need_rerun"),
        one_of("SUGGEST_OCR_QUALITY", ("fast", "balanced", "high"), "balanced").alias("ocr_quality"),
        one_of("SUGGEST_TABLE_ACCURACY", ("fast", "accurate"), "accurate").alias("table_accuracy"),
        yes("SUGGEST_GENERATE_PAGE_IMAGES").alias("page_images"),
        raw.alias("raw"),
    ).cast(QUALITY_CHECK)
