"""Language identification by character models: lowest cross-entropy, with calibrated rejection."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import charlm
from foliant.llm.common import stage

UNKNOWN = "und"
#: How fast the score nears 1 as the runner-up's cross-entropy grows, per nat a character.
SHARPNESS = 8.0
#: A text is rejected where its cross-entropy is above this share of the training texts of its language.
ACCEPTED = 0.999


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = charlm.MOST) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy) per row of `docs`.

    train: (label, text); rows with a null label or text teach nothing. A text that is null or has no
    letter is `und` with score 0, and so is every text if nothing was learned. Ties go to the first label. Beyond
    `most` n-grams an order, the rarer ones are joined: the result stays that of the whole models.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    usable = train.where("label IS NOT NULL AND text IS NOT NULL")
    lettered = lambda texts: [pa.array([has_letter(t) for t in texts], pa.bool_())]
    found, labels = charlm.entropies(picked, usable, lettered, "lettered boolean", False, True, most)
    if not labels:
        return found.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"))
    h = F.transform("nats", lambda x: x / F.greatest(F.col("n_grams"), F.lit(1)))
    found = found.select("doc_id", "lettered", "n_grams", h.alias("h"), F.array_min(h).alias("own"))
    place = F.array_position("h", F.col("own")).cast("int")
    surest = 1 / F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(-SHARPNESS * (x - F.col("own"))))
    return found.select(
        "doc_id",
        F.when(F.col("lettered"), F.element_at(F.array(*map(F.lit, labels)), place)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), surest).otherwise(0.0).alias("score"),
        F.when(F.col("lettered") & (F.col("n_grams") > 0), F.col("own")).alias("cross_entropy"),
    )


def held_out(id_col: str, modulus: int = 3, rest: int = 1):  # noqa: ANN201
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == rest, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) per row of `docs`.

    Learns from the rows that are not held out. A row without an id is not held out. `rejected` marks texts
    whose cross-entropy is beyond nearly all training texts predicted alike; their lang_pred stays.
    """
    train = docs.where(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    found = stage(predict(docs, train, id_col, text_col).withColumn("held_out", held_out("doc_id")), "languages")
    limits = found.where(~F.col("held_out")).groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", ACCEPTED, 10000).alias("limit"))
    out = found.join(F.broadcast(limits), "lang_pred", "left")  # a row a language
    rejected = F.coalesce(F.col("cross_entropy") > F.col("limit"), F.col("lang_pred") == UNKNOWN)
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", rejected.alias("rejected"))
