"""Mix sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import fresh, stage

#: Thresholds are rounded to this many decimals, so that every engine inverts the same distribution.
DECIMALS = 12
#: Sources whose rates are broadcast (each some hundred bytes); more are joined, over so many tasks a source.
SOURCES, SALTS = 10_000, 32


def poisson_thresholds(rate: Column) -> Column:
    """P(count <= k) for k from 0, as far as a 52-bit number can tell it from 1."""
    top = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.lit(0.0).alias("log_k"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_k = acc["log_k"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)
        total = acc["sum"] + F.exp(-rate + k * F.log(rate) - log_k)
        return F.struct(log_k.alias("log_k"), total.alias("sum"), F.array_append(acc["cdf"], F.round(total, DECIMALS)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), top), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def seeded(seed: int, *parts: Column) -> Column:
    """The MD5 of the seed and the parts, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def uniform(digest: Column) -> Column:
    """A number in [0, 1) from a digest's first 52 bits."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, rate): the mean number of copies of each source's documents.

    weights: shares of the mixture, scaled to 1; a source that they don't name gets none. Without them each
    source's share is its count to the power `temperature`. The mixture has about `epochs` times the rows
    of `docs`. Documents without a source are a source of their own.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        wanted = counts.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        named = docs.sparkSession.createDataFrame(list(weights.items()), "source string, w double")
        wanted = counts.join(F.broadcast(named), "source", "left").fillna(0.0, ["w"])
    total = wanted.agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all"))  # one row
    share = F.when(F.col("w_all") > 0, F.col("w") / F.col("w_all")).otherwise(0.0)
    return wanted.join(F.broadcast(total)).select("source", (F.round(share * F.col("n_all") * F.lit(epochs) / F.col("n"), 9)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """`docs`, each row as often as its Poisson count, in an order shuffled globally.

    Adds copy_no (from 1) and shuffle_key; columns of these names in `docs` are replaced. Counts depend on
    the seed, the id and the rate alone, so a lost task gives the same rows again; repeated rows get equal
    counts. A null id counts as an empty one; an empty table gives an empty result.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    key, cdf, n, salt = fresh(docs.columns, "source_key", "cdf", "n", "salt")
    found = rates(docs, weights, temperature, epochs, source_col)
    plan = stage(found.select(F.col("source").alias(key), poisson_thresholds(F.col("rate")).alias(cdf)), "rates")
    u = uniform(seeded(seed, docs[id_col]))
    same = docs[source_col].cast("string").eqNullSafe(F.col(key))
    if plan.count() <= SOURCES:
        counted = docs.join(F.broadcast(plan), same)
    else:  # a hot source is dealt over SALTS tasks
        own = docs.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        every = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(f"{salt}_of"))
        counted = own.join(every, same & (F.col(salt) == F.col(f"{salt}_of"))).drop(salt, f"{salt}_of")
    counted = counted.withColumn(n, F.size(F.filter(cdf, lambda c: c <= u))).where(F.col(n) > 0).drop(cdf, key)
    copies = counted.select("*", F.explode(F.sequence(F.lit(1), F.col(n))).alias("copy_no")).drop(n)
    keyed = copies.withColumn("shuffle_key", seeded(seed, F.col(id_col), F.col("copy_no")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
