"""Every query of the library outside the corpus operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import queries_figures, queries_generic, queries_images, queries_jobs, queries_markdown, queries_stream, queries_text

_ALL = queries_jobs.QUERIES | queries_markdown.QUERIES | queries_figures.QUERIES | queries_images.QUERIES | queries_text.QUERIES | queries_generic.QUERIES | queries_stream.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
