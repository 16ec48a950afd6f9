"""Quality rules: plain counts, then n-gram perplexity within language-specific bands."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import charlm
from foliant.llm.common import stage

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A band reaches from the language's median log-perplexity (nats a word) by so many deviations (1.4826 times
#: the median absolute deviation), and by REACH times the median at least.
DEVIATIONS, REACH = 6.0, 0.25
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, repeated_lines = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated_lines += bool(line.split(None, 1))
        else:
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeated_lines, repeated


def scored(docs: DataFrame, most: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Base counts and log-perplexity of every row."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    train = picked.select(F.lit("all").alias("label"), "text")

    def counts(texts: list[str | None]) -> list[pa.Array]:
        own = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, len(FIELDS))
        return [pa.array(own[:, i]) for i in range(len(FIELDS))]

    found, _ = charlm.entropies(picked, train, counts, ", ".join(f"{c} long" for c in FIELDS), True, False, most)
    log = F.coalesce(F.get("nats", F.lit(0)), F.lit(0.0)) / F.greatest(F.col("n_words"), F.lit(1))
    return found.select("doc_id", "lang", *FIELDS, log.alias("log_perplexity"))


def quality_rules(docs: DataFrame, deviations: float = DEVIATIONS, reach: float = REACH, most: int = charlm.MOST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, lower, upper) per row.

    The model counts the characters of all texts; perplexity is per word, so that long and short words weigh alike. Bands come from the rows of a language that pass the base
    rules; rows without a language have a band of their own. A null text has no words and fails the base
    rules; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    found = stage(scored(docs, most, id_col, text_col, lang_col).withColumn("base_failed", failed), "quality")
    fine = found.where("NOT base_failed").select("lang", F.col("log_perplexity").alias("x"))
    middle = fine.groupBy(F.col("lang").alias("band")).agg(F.percentile_approx("x", 0.5, 10000).alias("mid"))
    off = fine.join(middle, F.col("lang").eqNullSafe(F.col("band"))).select("band", "mid", F.abs(F.col("x") - F.col("mid")).alias("off"))
    spread = off.groupBy("band").agg(F.first("mid").alias("mid"), F.percentile_approx("off", 0.5, 10000).alias("mad"))
    width = F.greatest(reach * F.col("mid"), 1.4826 * deviations * F.col("mad"))
    bands = spread.select("band", F.exp(F.col("mid") - width).alias("lower"), F.exp(F.col("mid") + width).alias("upper"))
    out = found.withColumn("perplexity", F.exp("log_perplexity")).join(bands, F.col("lang").eqNullSafe(F.col("band")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select("doc_id", *FIELDS, "base_failed", kept.alias("kept"), "perplexity", "lower", "upper")
