"""Interpolated Kneser-Ney character models, counted by Spark and kept in sorted arrays.

A character takes 16 bits, so an n-gram of up to four is one 64-bit number: its own perfect hash. Spark takes the
counts, the continuation counts of lower orders, the counts of counts and the contexts' totals over all n-grams
of all texts. The tables that reach the driver and the workers grow with the texts up to `most` n-grams an
order. Beyond, `entropies` keeps the frequent n-grams' exact log-probabilities in the workers and joins the others
with a table of all, so that nothing is left out. (`fit` alone leaves n-grams below the smallest power of two that
fits to the lower order, which takes over exactly the probability that they had.)
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from foliant.llm.common import lean, stage, unstage

ORDER = 4
#: Characters handled at one go, and n-grams of one order that the tables of all labels hold: a bound on memory.
CHUNK, MOST = 1 << 20, 2_000_000
OTHER = 0xFFFF
_MAPS: dict[bool, np.ndarray] = {}


def character_map(letters_only: bool) -> np.ndarray:
    """Code point to code: letters in lower case, digits as 0, blanks as one; other signs as they are or blank."""
    if letters_only not in _MAPS:
        out = np.full(0x10000, 32, dtype=np.uint64)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
            elif not letters_only and not c.isspace():
                out[i] = 48 if unicodedata.category(c) == "Nd" else i
        _MAPS[letters_only] = out
    return _MAPS[letters_only]


def encode(texts: list[str], letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, one blank before and after each and blanks run together, and the text each is of."""
    raw = [f" {t} ".encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"".join(raw), dtype="<u4")
    codes = np.where(points < 0x10000, character_map(letters_only)[np.minimum(points, 0xFFFF)], OTHER)
    owner = np.repeat(np.arange(len(texts)), [len(r) // 4 for r in raw])
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    return codes[keep], owner[keep]


def grams(codes: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that lie within one text, and the text each is of."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.zeros(n, dtype=np.uint64)
    for i in range(order):
        keys = keys << np.uint64(16) | codes[i : n + i]
    inside = owner[:n] == owner[order - 1 :]
    return keys[inside], owner[:n][inside]


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about `size` characters, with the place of the first."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield at, texts[at : i + 1]
            at, total = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def count_grams(docs: DataFrame, order: int, letters_only: bool) -> DataFrame:
    """(label, key, n) over every text of `docs` (label string, text string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            by: dict[str | None, list[str]] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    by.setdefault(label, []).append(text)
            for label, texts in by.items():
                own = held.setdefault(label, [])
                for _, part in chunks(texts, CHUNK):
                    own.append(np.unique(grams(*encode(part, letters_only), order)[0], return_counts=True))
                    if sum(len(k) for k, _ in own) > 2 * CHUNK:
                        own[:] = [summed(own)]
        for label, own in held.items():
            keys, n = summed(own)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["label", "key", "n"])

    counted = docs.select(F.col("label").cast("string").alias("label"), "text").mapInArrow(lean(run), "label string, key long, n long")
    return counted.groupBy("label", "key").agg(F.sum("n").alias("n"))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(unique)).astype(np.int64)


def look_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def discounts(by: list[float], modified: bool) -> np.ndarray:
    """What is taken off counts of one, two and more. by: how many n-grams were counted once to four times."""
    by = [max(1.0, float(x)) for x in by]
    y = by[0] / (by[0] + 2 * by[1])
    return np.array([y] * 3 if not modified else [min(max(i - (i + 1) * y * by[i] / by[i - 1], 0.1), i - 0.05) for i in (1, 2, 3)])


def level(keys: np.ndarray, counts: np.ndarray, steps: np.ndarray, contexts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted tables of one order: n-grams with what is their own, contexts with what goes to the lower order.

    contexts and totals cover all that was counted; what isn't among the keys is left to the lower order.
    """
    sort = np.argsort(keys)
    keys, counts = keys[sort], counts[sort].astype(np.float64)
    sort = np.argsort(contexts)
    contexts, totals = contexts[sort], totals[sort].astype(np.float64)
    where = np.searchsorted(contexts, keys >> np.uint64(16))
    own = (counts - steps[np.clip(counts, 1, 3).astype(int) - 1]) / totals[where] if len(keys) else counts
    freed = np.clip(1 - np.bincount(where, weights=own, minlength=len(contexts)), 0, 1)
    return keys, own, contexts, freed


class KneserNey:
    """One language's model. Lower orders count distinct predecessors; a modified one has three discounts an order."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], alphabet: int = 256) -> None:
        self.levels, self.order, self.alphabet = levels, len(levels), alphabet

    @classmethod
    def of_counts(cls, keys: np.ndarray, counts: np.ndarray, order: int, modified: bool) -> KneserNey:
        """The model of counts that are all at hand."""
        levels = []
        for k in range(order, 0, -1):
            contexts, where = np.unique(keys >> np.uint64(16), return_inverse=True)
            steps = discounts([(counts == i).sum() for i in (1, 2, 3, 4)], modified)
            levels.insert(0, level(keys, counts, steps, contexts, np.bincount(where, weights=counts, minlength=len(contexts))))
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
        return cls(levels)

    def probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / self.alphabet)
        for k, (known, own, contexts, freed) in enumerate(self.levels, 1):
            part = keys & np.uint64((1 << 16 * k) - 1) if k < 4 else keys
            at, there = look_up(known, part)
            c, seen = look_up(contexts, part >> np.uint64(16))
            p = np.where(seen, np.where(there, own[at] if len(own) else 0.0, 0.0) + (freed[c] if len(freed) else 0.0) * p, p)
        return p


class Models:
    """Models of several labels over one sorted table: a look-up gives every label's log-probability."""

    def __init__(self, models: dict[str, KneserNey], order: int, letters_only: bool) -> None:
        self.labels, self.order, self.letters_only = sorted(models), order, letters_only
        self.models = [models[x] for x in self.labels]
        self.keys = np.unique(np.concatenate([m.levels[-1][0] for m in self.models])) if self.models else np.zeros(0, np.uint64)
        self.logs = self.computed(self.keys)

    def computed(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty((len(keys), len(self.models)), dtype=np.float32)
        for i, m in enumerate(self.models):
            out[:, i] = np.log(m.probability(keys))
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character under each label, and the number of n-grams, of each text."""
        total, count = np.zeros((len(texts), len(self.models))), np.zeros(len(texts), dtype=np.int64)
        for first, part in chunks(texts, CHUNK // 4):
            keys, owner = grams(*encode(part, self.letters_only), self.order)
            at, there = look_up(self.keys, keys)
            logs = self.logs[at] if len(self.keys) else np.zeros((len(keys), len(self.models)), np.float32)
            missing = np.flatnonzero(~there)
            if len(missing) and self.models:
                new, where = np.unique(keys[missing], return_inverse=True)
                logs[missing] = self.computed(new)[where]
            for i in range(len(self.models)):
                total[first : first + len(part), i] -= np.bincount(owner, weights=logs[:, i], minlength=len(part))
            count[first : first + len(part)] = np.bincount(owner, minlength=len(part))
        return total / np.maximum(count, 1)[:, None], count


def all_orders(counted: DataFrame, order: int) -> DataFrame:
    """(order, label, key, c): counts of the highest order, and for each lower one how many n-grams end in it."""
    now = counted.where("label IS NOT NULL").select("label", "key", F.col("n").alias("c"))
    out = now.withColumn("order", F.lit(order))
    for k in range(order - 1, 0, -1):
        now = now.groupBy("label", F.col("key").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("key")).agg(F.count("*").alias("c"))
        out = out.unionByName(now.withColumn("order", F.lit(k)))
    return out


def fit(docs: DataFrame, order: int = ORDER, modified: bool = False, letters_only: bool = True, most: int = MOST) -> Models:
    """Models of each label of `docs` (label, text); rows without a label teach nothing. See above for `most`.

    The driver gets, for each label and order, a row for each power of two among the counts, and the tables.
    """
    rows, stats = counted_orders(docs, order, letters_only)
    out = of_tables(rows, stats, order, modified, letters_only, floors(stats, order, most))
    unstage(rows)
    return out


def counted_orders(docs: DataFrame, order: int, letters_only: bool) -> tuple[DataFrame, list[Row]]:
    """all_orders() as a staged table, from one look at the texts, and its statistics: a row an order, label and power of two."""
    counted = stage(count_grams(docs, order, letters_only), "counted")
    rows = stage(all_orders(counted, order), "grams")
    unstage(counted)
    power = F.floor(F.log2("c")).cast("int")
    ones = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    return rows, rows.groupBy("order", "label", power.alias("power")).agg(F.count("*").alias("n"), *ones).collect()


def floors(stats: list[Row], order: int, most: int) -> dict[int, int]:
    """For each order the smallest power of two below which at most `most` n-grams are counted as often."""
    out = {}
    for k in range(1, order + 1):
        sizes = [sum(r.n for r in stats if r.order == k and r.power >= p) for p in range(64)]
        out[k] = 1 << next(p for p in range(64) if sizes[p] <= max(most, sizes[63]))
    return out


def steps_of(stats: list[Row], k: int, label: str, modified: bool) -> np.ndarray:
    return discounts([sum(r[f"n{i}"] for r in stats if (r.order, r.label) == (k, label)) for i in (1, 2, 3, 4)], modified)


def of_tables(rows: DataFrame, stats: list[Row], order: int, modified: bool, letters_only: bool, floor: dict[int, int]) -> Models:
    """Models of the n-grams that were counted as often as their order's floor."""
    least = F.element_at(F.array(*[F.lit(floor[k]) for k in range(1, order + 1)]), F.col("order"))
    kept = rows.where(F.col("c") >= least).select("order", "label", "key", "c").toArrow()
    totals = rows.groupBy("order", "label", F.shiftrightunsigned("key", 16).alias("key")).agg(F.sum("c").alias("c"), F.max("c").alias("top"))
    totals = totals.where(F.col("top") >= least).select("order", "label", "key", "c").toArrow()

    def parted(table: pa.Table) -> dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]:
        labels = table.column("label").combine_chunks().dictionary_encode()
        of, orders = labels.indices.to_numpy(zero_copy_only=False), table.column("order").to_numpy()
        keys, n = table.column("key").to_numpy().view(np.uint64), table.column("c").to_numpy()
        own = {(k, x): np.flatnonzero((of == i) & (orders == k)) for i, x in enumerate(labels.dictionary.to_pylist()) for k in range(1, order + 1)}
        return {at: (keys[rows], n[rows]) for at, rows in own.items()}

    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    grams_of, totals_of, models = parted(kept), parted(totals), {}
    for label in sorted({r.label for r in stats}):
        levels = []
        for k in range(1, order + 1):
            levels.append(level(*grams_of.get((k, label), none), steps_of(stats, k, label, modified), *totals_of.get((k, label), none)))
        models[label] = KneserNey(levels)
    return Models(models, order, letters_only)


def low(key: str, k: int, order: int) -> Column:
    """The last k characters of an n-gram."""
    return F.col(key) if k == order == 4 else F.col(key).bitwiseAND(F.lit((1 << 16 * k) - 1))


def log_probabilities(asked: DataFrame, rows: DataFrame, stats: list[Row], order: int, modified: bool) -> DataFrame:
    """(key, logs array<double>): of every n-gram of `asked` (key), the log-probability under each label, from all of `rows`.

    A staged table. Each order is joined with its counts, its contexts and the order below: nothing is held whole.
    """
    spark, labels = asked.sparkSession, sorted({r.label for r in stats})
    taken = [(k, x, *map(float, steps_of(stats, k, x, modified))) for k in range(1, order + 1) for x in labels]
    taken = F.broadcast(spark.createDataFrame(taken, "order int, label string, d1 double, d2 double, d3 double"))  # a row an order and label
    step = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    priced = rows.join(taken, ["order", "label"]).select("order", "label", "key", (F.col("c") - step).alias("own"), "c", step.alias("step"))
    before = None
    for k in range(1, order + 1):
        keys = asked.select(low("key", k, order).alias("key")).distinct()
        now = keys.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in labels], "label string")))
        now = now.withColumns({"context": F.shiftrightunsigned("key", 16), "under": low("key", k - 1, order)})
        of = priced.where(F.col("order") == k)
        contexts = of.groupBy("label", F.shiftrightunsigned("key", 16).alias("context")).agg(F.sum("c").alias("total"), F.sum("step").alias("freed"))
        now = now.join(of.select("label", "key", "own"), ["label", "key"], "left").join(contexts, ["label", "context"], "left")
        if before is None:
            now = now.withColumn("p", F.lit(1 / 256))
        else:
            now = now.join(before.select("label", F.col("key").alias("under"), "p"), ["label", "under"])
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise((F.coalesce("own", F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("total"))
        staged = stage(now.select("label", "key", p.alias("p")), "probabilities")
        if before is not None:
            unstage(before)
        before = staged
    every = before.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("label", F.log("p").alias("log")))).alias("l"))  # a value a label
    out = stage(every.select("key", F.col("l.log").alias("logs")), "logs")
    unstage(before)
    return out


class Frequent:
    """Log-probabilities of the n-grams that are looked up in the workers; those that are asked for apart come as rows."""

    def __init__(self, table: pa.Table, n_labels: int, order: int, letters_only: bool) -> None:
        keys = table.column("key").to_numpy().view(np.uint64)
        sort = np.argsort(keys)
        logs = table.column("logs").combine_chunks()
        self.keys, self.logs = keys[sort], np.asarray(logs.flatten()).reshape(-1, n_labels)[sort]
        self.n_labels, self.order, self.letters_only = n_labels, order, letters_only

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list[int]]]:
        """Nats under each label of the n-grams at hand, the number of all, and the others with how often, of each text."""
        total, count = np.zeros((len(texts), self.n_labels)), np.zeros(len(texts), dtype=np.int64)
        rare, times = [[] for _ in texts], [[] for _ in texts]
        for first, part in chunks(texts, CHUNK // 4):
            keys, owner = grams(*encode(part, self.letters_only), self.order)
            at, there = look_up(self.keys, keys)
            for i in range(self.n_labels if there.any() else 0):
                total[first : first + len(part), i] -= np.bincount(owner[there], weights=self.logs[at[there], i], minlength=len(part))
            count[first : first + len(part)] = np.bincount(owner, minlength=len(part))
            own, keys = owner[~there], keys[~there].view(np.int64)
            sort = np.lexsort((keys, own))
            own, keys = own[sort], keys[sort]
            starts = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])))) if len(own) else own
            sizes = np.diff(np.append(starts, len(own)))
            for x, key, n in zip(own[starts].tolist(), keys[starts].tolist(), sizes.tolist(), strict=True):
                rare[first + x].append(key)
                times[first + x].append(n)
        return total, count, rare, times


Facts = Callable[[list[str | None]], list[pa.Array]]


def entropies(docs: DataFrame, train: DataFrame, facts: Facts, schema: str, modified: bool, letters_only: bool, most: int) -> tuple[DataFrame, list[str]]:
    """`docs` (…, text) with facts of the text (`schema`), its n-grams and the nats of all, an array by label, in its place; and the labels.

    Whatever the number of n-grams, the probabilities are those of models of all of them. If an order has more than `most`, only
    the log-probabilities of those counted most often are in the workers; the rest of a text's n-grams become rows, which
    are joined with a table of all and summed.
    """
    rows, stats = counted_orders(train.where("label IS NOT NULL"), ORDER, letters_only)
    labels, floor, sc = sorted({r.label for r in stats}), floors(stats, ORDER, most), docs.sparkSession.sparkContext
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    names, known = [f.name for f in docs.schema if f.name != "text"], f"{others}, {schema}, n_grams long, nats array<double>"
    fits = max(floor.values()) == 1
    if fits:
        shared = sc.broadcast(of_tables(rows, stats, ORDER, modified, letters_only, floor))
    else:
        asked = count_grams(docs.select(F.lit("all").alias("label"), "text"), ORDER, letters_only).select("key")
        logs = log_probabilities(asked, rows, stats, ORDER, modified)
        often = rows.where((F.col("order") == ORDER) & (F.col("c") >= floor[ORDER])).select("key").distinct()
        shared = sc.broadcast(Frequent(logs.join(often, "key").toArrow(), len(labels), ORDER, letters_only))
    unstage(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found, count, *rare = models.cross_entropy([t or "" for t in texts])
            nats = found * np.maximum(count, 1)[:, None] if fits else found
            arrays = [*(batch.column(c) for c in names), *facts(texts), pa.array(count), pa.array(list(nats), pa.list_(pa.float64()))]
            arrays += [pa.array(x, pa.list_(pa.int64())) for x in rare]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *extra, "n_grams", "nats", *["rare", "times"][: len(rare)]])

    extra = [f.split()[0] for f in schema.split(", ")]
    if fits:
        return docs.mapInArrow(run, known), labels
    split = stage(docs.mapInArrow(run, f"{known}, rare array<long>, times array<long>").withColumn("__row", F.monotonically_increasing_id()), "split")
    apart = split.select("__row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("__row", F.col("x.rare").alias("key"), F.col("x.times").alias("n"))
    # sums by label as columns of their own: few labels
    sums = [F.sum(-F.col("n") * F.get("logs", F.lit(i))).alias(f"s{i}") for i in range(len(labels))]
    more = apart.join(logs, "key").groupBy("__row").agg(*sums).select("__row", F.array(*[f"s{i}" for i in range(len(labels))]).alias("more"))
    whole = F.when(F.col("more").isNull(), F.col("nats")).otherwise(F.zip_with("nats", "more", lambda a, b: a + b))
    out = stage(split.join(more, "__row", "left").withColumn("nats", whole).select(*names, *extra, "n_grams", "nats"), "entropies")
    unstage(split, logs)
    return out, labels
