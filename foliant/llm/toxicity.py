"""Toxicity: undo leetspeak, spacing and repetition by a noisy-channel decoder, then score the restored text.

Words that carry such noise become lattices of possible letters; Viterbi search under a character model of
the corpus picks the best restorations, and a sparse rule list learned from labelled texts scores all words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import charlm
from foliant.llm.common import lean, stage, unstage
from foliant.llm.lines import MAPPED, picked

#: The letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "£": "l", "¢": "c", "(": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
GAPS = ".-_~'·,;:/\\"
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_~/\\…«»¿¡“”‘’"
#: Log-costs of the channel: a sign for a letter, a letter written again, a gap within a word, one between words of a spelt-out run.
COST_SIGN, COST_AGAIN, COST_GAP, COST_BREAK = -0.5, -1.0, -0.2, -1.5
#: Hypotheses kept at each letter for each state, and restorations handed on.
KEEP, BEST = 3, 8
#: A rule needs so many toxic texts that no earlier rule covers, and this precision.
LEAST, PRECISION = 5, 0.8
#: Rules that are in the workers at one time: of more, each part has a pass of its own.
PART = 500_000
#: Words that a worker remembers, words whose features it remembers, and features that it counts before they leave it.
MEMORY, TELLING, COUNTED = 400_000, 50_000, 100_000
#: Texts of a batch that a worker holds as strings at one go.
DOCS = 512
ORDER = 3
SPACED = re.compile(r"(?<!\S)(\S(?:\s\S){2,})(?!\S)")
#: Signs that end or begin a word without being part of it: those of EDGES that stand for no consonant, and long runs.
SOFT_EDGES = "".join(c for c in EDGES if c not in "$|!<")
RUNS = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}[.,;:]*$")
AGAIN = re.compile(r"(.)\1\1")
BETWEEN = re.compile(r"\w(?:[.\-_~·*/]\w){2,}")


class Decoder:
    """Viterbi search over a character lattice under a letter model."""

    def __init__(self, model: charlm.KneserNey) -> None:
        self.model, self.memo = model, {}

    def cost(self, context: str, letter: str) -> float:
        got = self.memo.get((context, letter))
        if got is None:
            key = packed((context + letter)[-self.model.order :])
            got = math.log(float(self.model.probability(np.array([key], dtype=np.uint64))[0]))
            if len(self.memo) < MEMORY:
                self.memo[context, letter] = got
        return got

    def __call__(self, lattice: list[list[tuple[str, float]]], best: int = BEST) -> list[str]:
        """The `best` likeliest readings. Each place has (letter, cost) choices; '' writes nothing, '=' the letter before.

        A state is the context that the model sees; the list search keeps KEEP readings of each.
        """
        back = self.model.order - 1
        beams = {" " * back: [(0.0, "")]}
        for choices in lattice:
            grown: dict[str, list[tuple[float, str]]] = {}
            for context, readings in beams.items():
                for letter, cost in choices:
                    if letter == "=" and not readings[0][1]:
                        continue
                    write = letter if letter not in ("", "=") else ""
                    add = cost + (self.cost(context, write) if write else 0.0)
                    state = (context + write)[-back:]
                    grown.setdefault(state, []).extend((s + add, r + write) for s, r in readings)
            beams = {c: sorted(set(r), key=lambda x: (-x[0], x[1]))[:KEEP] for c, r in grown.items()}
        ended = [(s + self.cost(c, " "), r) for c, readings in beams.items() for s, r in readings if r]
        return list(dict.fromkeys(r for _, r in sorted(ended, key=lambda x: (-x[0], x[1]))))[:best]

    def read(self, form: str, spaced: bool) -> list[str]:
        return self(lattice(form, spaced))


class Told:
    """In a decoder's place: readings that were found elsewhere."""

    def __init__(self) -> None:
        self.readings: dict[tuple[str, bool], list[str]] = {}

    def read(self, form: str, spaced: bool) -> list[str]:
        return self.readings[form, spaced]


class Asked:
    """In a decoder's place: notes what it would read."""

    def __init__(self) -> None:
        self.forms: set[tuple[str, bool]] = set()

    def read(self, form: str, spaced: bool) -> list[str]:
        self.forms.add((form, spaced))
        return []


class Given:
    """A letter model of the n-grams that one search asks for."""

    def __init__(self, keys: list[int], logs: list[float]) -> None:
        self.order, self.known = ORDER, dict(zip(keys, logs, strict=True))

    def probability(self, keys: np.ndarray) -> np.ndarray:
        return np.exp([self.known[int(k)] for k in keys])


def packed(gram: str) -> int:
    key = 0
    for c in gram:
        key = key << 16 | min(ord(c), 0xFFFF)
    return key


def asked_keys(form: str, spaced: bool) -> set[int]:
    """The n-grams whose probability the search for a form's readings may ask for."""
    contexts, out = {" " * (ORDER - 1)}, set()
    for choices in lattice(form, spaced):
        grown = set()
        for letter, _ in choices:
            write = letter if letter != "=" else ""
            out.update(packed(c + write) for c in contexts if write)
            grown.update((c + write)[1 - ORDER :] for c in contexts)
        contexts = grown
    return out | {packed(c + " ") for c in contexts}


def lattice(word: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """Choices for each sign of a lower-case word."""
    out, last = [], ""
    for c in word:
        choices = []
        if c.isalpha():
            choices.append((c, 0.0))
            if c == last:
                choices.append(("=", COST_AGAIN))
        for letter in LEET.get(c, ""):
            choices.append((letter, COST_SIGN - math.log(len(LEET[c]))))
        if c.isspace() or c in GAPS or (spaced and not choices):
            choices.append(("", COST_GAP))
        if c.isspace() and spaced:
            choices.append((" ", COST_BREAK))
        if not choices:
            choices.append(("", -4.0))
        out.append(choices)
        last = c
    return out


def noisy(word: str) -> bool:
    """Whether a stripped lower-case word may hide another: signs among letters, or a letter three times over."""
    if word.isalpha():
        return AGAIN.search(word) is not None
    return any(map(str.isalpha, word)) and (any(c in LEET for c in word) or BETWEEN.fullmatch(word) is not None)


def restore(decode: Decoder | Told | Asked, word: str) -> list[str]:
    """Readings of one blank-free word, the plain one first: what the score looks at."""
    bare = word.strip(EDGES)
    if bare.isalpha() and word.rstrip(".,;:") == bare and not AGAIN.search(bare):
        return [bare]
    parts = [p for p in re.split(r"[^\w]+", bare) if p.isalpha()]
    forms = [bare] if bare.isalpha() else parts
    whole = RUNS.sub("", word).strip(SOFT_EDGES)
    for form in dict.fromkeys((bare, whole)):
        if form and noisy(form):
            forms += decode.read(form, BETWEEN.fullmatch(form) is not None)
    return list(dict.fromkeys(forms))


def spaced_runs(text: str) -> list[str]:
    """Runs of single signs with blanks between, such as a word spelt out."""
    return [m for m in SPACED.findall(text) if sum(map(str.isalpha, m)) >= 2 and len(m) >= 5]


def features(form: str) -> list[str]:
    """The word and its beginnings; what learned rules may name. Longer ones come first."""
    return [f"={form}", *[f"^{form[:n]}" for n in (6, 5, 4) if len(form) >= n]]


class Reader:
    """The features of a text's words, plain and restored. Words without a feature of interest are remembered."""

    def __init__(self, decode: Decoder | Told | Asked, wanted: Collection[str] | None = None) -> None:
        self.decode, self.wanted = decode, wanted
        self.dull: set[str] = set()
        self.telling: dict[str, list[str]] = {}

    def of_word(self, word: str) -> list[str]:
        found = [f for form in restore(self.decode, word) for f in features(form)]
        return found if self.wanted is None else [f for f in found if f in self.wanted]

    def __call__(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        out: set[str] = set()
        if len(self.dull) > MEMORY:
            self.dull.clear()
        if len(self.telling) > TELLING:
            self.telling.clear()
        for word in set(low.split()) - self.dull:
            got = self.telling.get(word)
            if got is None:
                got = self.of_word(word)
                if got:
                    self.telling[word] = got
                else:
                    self.dull.add(word)
            out.update(got)
        for run in spaced_runs(low):
            for word in {w for reading in self.decode.read(run, True) for w in reading.split()}:
                out.update(f for f in features(word) if self.wanted is None or f in self.wanted)
        return out


def bucket(id_col: str | Column, modulus: int = 5) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string")) % modulus


@dataclass
class Texts:
    """Rows with a text column, and what reads their words: a letter model in the workers, or readings beside each text."""

    rows: DataFrame
    text_col: str
    model: Broadcast | None

    def found(self, rows: DataFrame, keep: list[str], column: str, wanted: Broadcast | None = None) -> DataFrame:
        """The kept columns of `rows`, with those features of the text that are wanted added to `column` array<string>."""
        at, model, text_col = [c for c in keep if c != column], self.model, self.text_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read_at = Reader(Told() if model is None else Decoder(model.value), None if wanted is None else wanted.value)
            for batch in batches:
                found = [sorted(x) for x in read_batch(read_at, batch, text_col)]
                if column in batch.schema.names:
                    found = [old + new for old, new in zip(batch.column(column).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in at), pa.array(found, pa.list_(pa.string()))], [*at, column])

        return rows.mapInArrow(lean(run), ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in at) + f", {column} array<string>")


def read_batch(read_at: Reader, batch: pa.RecordBatch, text_col: str) -> Iterator[set[str]]:
    """The features of each text of a batch."""
    for first in range(0, batch.num_rows, DOCS):
        part = batch.slice(first, DOCS)
        told = part.column(TOLD).to_pylist() if TOLD in batch.schema.names else None
        for i, text in enumerate(part.column(text_col).to_pylist()):
            if told is not None:
                read_at.decode.readings = {(x["form"], x["spaced"]): x["readings"] for x in told[i] or ()}
            yield read_at(text)


#: A column beside the text, if the letter model has more n-grams than its tables hold: the readings of its noisy words.
TOLD = "__told"


def texts_of(docs: DataFrame, text_col: str, most: int) -> Texts:
    """`docs` with what reads them. Of a letter model of more than `most` n-grams an order, each noisy form gets those that
    its search asks for, by a join, and each text the readings of its forms."""
    every = docs.select(F.lit("all").alias("label"), F.col(text_col).alias("text"))
    rows, stats = charlm.counted_orders(every, ORDER, True)
    floor = charlm.floors(stats, ORDER, most)
    if max(floor.values()) == 1:
        models = charlm.of_tables(rows, stats, ORDER, False, True, floor).models
        unstage(rows)
        model = models[0] if models else charlm.KneserNey.of_counts(np.zeros(0, np.uint64), np.zeros(0, np.int64), ORDER, False)
        return Texts(docs, text_col, docs.sparkSession.sparkContext.broadcast(model))
    numbered = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    form = "array<struct<form: string, spaced: boolean>>"

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                asked = Asked()
                Reader(asked)(text)
                out.append([{"form": f, "spaced": s} for f, s in sorted(asked.forms)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("form", pa.string()), ("spaced", pa.bool_())])))], ["__row", "asked"])

    def asked_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sorted(asked_keys(f, s)) for f, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], ["form", "spaced", "keys"])

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, s, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out.append(Decoder(Given([y["key"] for y in x], [y["log"] for y in x])).read(f, s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["form", "spaced", "readings"])

    asked = numbered.select("__row", text_col).mapInArrow(asking, f"__row long, asked {form}").select("__row", F.inline("asked"))
    asked = stage(asked, "asked")
    keyed = stage(asked.select("form", "spaced").distinct().mapInArrow(asked_of, "form string, spaced boolean, keys array<long>").select("form", "spaced", F.explode("keys").alias("key")), "keyed")
    logs = charlm.log_probabilities(keyed.select("key").distinct(), rows, stats, ORDER, False)
    own = keyed.join(logs.select("key", F.get("logs", F.lit(0)).alias("log")), "key").groupBy("form", "spaced")
    own = own.agg(F.collect_list(F.struct("key", "log")).alias("given"))  # one form's n-grams
    readings = stage(own.mapInArrow(reading, "form string, spaced boolean, readings array<string>"), "readings")
    told = asked.join(readings, ["form", "spaced"]).groupBy("__row").agg(F.collect_list(F.struct("form", "spaced", "readings")).alias(TOLD))  # one text's forms
    out = stage(numbered.join(told, "__row", "left").drop("__row"), "told")
    unstage(rows, numbered, asked, keyed, logs, readings)
    return Texts(out, text_col, None)


def parts_of(table: DataFrame, fields: list[str], most: int) -> Iterator[pa.Table]:
    """The rows of `table` (f, …) in parts of about `most`, as the driver and the workers hold them."""
    parts = max(1, -(-table.count() // most))
    for i in range(parts):
        yield table.where(F.pmod(F.xxhash64("f"), F.lit(parts)) == i).select(fields).toArrow()


def tallied(texts: Texts, rows: DataFrame) -> DataFrame:
    """(f, t, c): in how many toxic and clean texts of `rows` (toxic, text, …) each feature stands."""
    model, text_col = texts.model, texts.text_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read_at, count = Reader(Told() if model is None else Decoder(model.value)), {}

        def counted() -> pa.RecordBatch:
            n = np.array(list(count.values()), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(n[:, 1]), pa.array(n[:, 0])], ["f", "t", "c"])

        for batch in batches:
            for toxic, found in zip(batch.column("toxic").to_pylist(), read_batch(read_at, batch, text_col), strict=True):
                for f in found:
                    count.setdefault(f, [0, 0])[toxic] += 1
                if len(count) > COUNTED:
                    yield counted()
                    count.clear()
        yield counted()

    return rows.mapInArrow(lean(run), "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def cover(sets: DataFrame, least: int = LEAST) -> DataFrame:
    """(f): of the features of `sets` (id, n, f) those that cover them, one after another, most texts first; a staged table.

    A set of features stands for n texts. A feature that comes before all others in each set that holds it is the next
    one there whatever happens elsewhere, so a round takes all such: the result is that of one after another.
    """
    left, rules = stage(sets, "left"), []
    while True:
        count = left.groupBy("f").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
        ranked = left.join(count, "f").select("id", "n", "f", F.struct("size", F.col("f").startswith("=").alias("whole"), F.length("f").alias("length"), "f").alias("rank"))
        ranked = stage(ranked, "ranked")
        best = ranked.groupBy("id").agg(F.max("rank").alias("best"))
        top = stage(ranked.join(best, "id").groupBy("f").agg(F.min(F.col("rank") == F.col("best")).alias("first")).where("first").select("f"), "rules")
        if top.first() is None:
            break
        rules.append(top)
        after = stage(ranked.join(ranked.join(top, "f").select("id").distinct(), "id", "left_anti").select("id", "n", "f"), "left")
        unstage(left, ranked)
        left = after
    unstage(left, ranked)
    for x in rules:
        top = top.union(x)
    return top


def judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, keep: list[str], most: int, part: int = PART) -> DataFrame:
    """The kept columns of `docs`, with __score and __rules, the learned ones that fire, strongest first.

    Rules are learned from every labelled text that isn't held out: their features are counted, those of the texts that have
    a strong one are looked at once more, with all other texts, and the rules picked from them.
    """
    own_id, digest = "__id", "__digest"
    docs = docs.withColumns({own_id: F.col(id_col).cast("long"), digest: F.md5(text_col)})
    texts = texts_of(docs, text_col, most)
    marked = labels.select(F.col("doc_id").cast("long").alias(own_id), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(f"toxic IS NOT NULL AND {own_id} IS NOT NULL").where(bucket(own_id) != 0)
    marked = marked.groupBy(own_id).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    kinds = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    # equal texts count once
    one = texts.rows.where(F.col(text_col).isNotNull()).select(own_id, digest).join(marked, own_id)
    one = stage(one.groupBy(digest).agg(F.max(F.struct("toxic", own_id)).alias("one")).select(digest, f"one.{own_id}", "one.toxic"), "taught")
    size = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    nt, nc = size.get(1, 0), size.get(0, 0)
    base = min(max(kinds.get(1, 0) / max(1, sum(kinds.values())), 1e-3), 1 - 1e-3)
    at = [own_id, digest]
    least = PRECISION / (1 - PRECISION) * (nt + 1) / (nc + 1) * (1 - base) / base
    told = [c for c in texts.rows.columns if c == TOLD]
    # a map of bits leaves nearly all other texts where they are; the join decides
    node = F.pmod(F.xxhash64(own_id), F.lit(MAPPED))
    near = picked(texts.rows.select(*at, text_col, *told, node.alias("node")), one.select(node.alias("node")).distinct(), MAPPED)
    tally = tallied(texts, near.join(one, at).dropDuplicates(at).select("toxic", text_col, *told))
    # the evidence of a feature, one clean text more assumed; odds are those of the labels
    evidence = F.log(F.col("t") / (nt + 1) * (nc + 1) / (F.col("c") + 1) * base / (1 - base))
    strong = stage(tally.where((F.col("t") >= LEAST) & (F.col("t") >= least * (F.col("c") + 1))).select("f", evidence.alias("weight")), "strong")
    rows, context = texts.rows, docs.sparkSession.sparkContext
    held = [c for c in dict.fromkeys([*keep, *at]) if c in rows.columns]
    tables, wanted = [], parts_of(strong, ["f"], part)
    now, ahead = next(wanted), next(wanted, None)
    while now is not None:
        shared = context.broadcast(frozenset(now.column("f").to_pylist()))
        more = [] if ahead is None else [c for c in (text_col, *told) if c not in held]
        tables.append(stage(texts.found(rows, [*held, *more], "__fired", shared), "fired"))
        rows, now, ahead = tables[-1], ahead, next(wanted, None)
    unstage(*tables[:-1])
    fired = rows.where(F.size("__fired") > 0).select(*at, "__fired").join(one, at).dropDuplicates(at)
    sets = fired.groupBy("toxic", F.array_sort("__fired").alias("l")).agg(F.count("*").alias("n"))
    sets = stage(stage(sets.withColumn("id", F.monotonically_increasing_id()), "sets").select("id", "toxic", "n", F.explode("l").alias("f")), "sets")
    rules = stage(cover(sets.where("toxic = 1").select("id", "n", "f")).join(strong, "f"), "rules")
    loud = sets.join(rules, "f").groupBy("id", "toxic", "n").count().groupBy("toxic").agg(F.sum("n").alias("n")).collect()  # two rows
    loud = {r.toxic: r.n for r in loud}
    silent = {kind: 1 - loud.get(kind, 0) / max(1, size.get(kind, 0)) for kind in (0, 1)}
    prior = math.log(max(silent[1] * base, 1e-4) / max(silent[0] * (1 - base), 1e-4))
    unstage(one, strong, sets)
    return scored(rows, rules, keep, prior, part)


def scored(rows: DataFrame, rules: DataFrame, keep: list[str], prior: float, part: int) -> DataFrame:
    """The kept columns of `rows` (…, __fired), with __score and __rules: `rules` (f, weight) are looked up a part at a time."""
    context, known = rows.sparkSession.sparkContext, "__known array<struct<weight: double, f: string>>"
    struct = pa.list_(pa.struct([("weight", pa.float64()), ("f", pa.string())]))
    rows = rows.withColumn("__known", F.array().cast("array<struct<weight: double, f: string>>"))
    others = [f for f in rows.schema if f.name != "__known"]
    schema, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others), [f.name for f in others]

    def looked_up(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = shared.value
            for batch in batches:
                out = []
                for old, fired in zip(batch.column("__known").to_pylist(), batch.column("__fired").to_pylist(), strict=True):
                    out.append(old + [{"weight": -weights[f], "f": f} for f in fired if f in weights])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, struct)], [*names, "__known"])

        return run

    for i, table in enumerate(parts_of(rules, ["f", "weight"], part)):
        rows = stage(rows, "scored") if i else rows
        shared = context.broadcast(dict(zip(table.column("f").to_pylist(), table.column("weight").to_pylist(), strict=True)))
        rows = rows.mapInArrow(lean(looked_up(shared)), f"{schema}, {known}")
    return rows.select(*keep, probability(F.array_sort("__known"), prior).alias("__score"), F.array_sort("__known")["f"].alias("__rules"))


def probability(known: Column, prior: float) -> Column:
    """The strongest rule decides, each further one adds a little; without a rule a text is below one half."""
    total = F.when(F.size(known) > 0, -F.get(known, F.lit(0))["weight"] + 0.1 * (F.size(known) - 1)).otherwise(min(prior, -0.01))
    return 1 / (1 + F.exp(-total))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, most: int = charlm.MOST) -> DataFrame:
    """The rows of `docs`, unchanged, whose text scores below `threshold`; the cases of score() hold."""
    return judged(docs, labels, id_col, text_col, docs.columns, most).where(F.col("__score") < threshold).select(docs.columns)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = charlm.MOST, part: int = PART) -> DataFrame:
    """(doc_id, held_out, score, predicted, rules) per row of `docs`.

    A row whose id's CRC-32 is divisible by five is held out: its label teaches nothing. Null and empty texts
    score what a text without any rule scores; a table without labels scores every text below 0.5. A row
    without an id is not held out. rules: the learned rules that fired. Beyond `most` n-grams an order of the letter
    model, or `part` rules, the result is the same, by joins and further passes.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = judged(picked, labels, "doc_id", "text", ["doc_id"], most, part)
    held = F.coalesce(bucket("doc_id") == 0, F.lit(False))
    predicted = (F.col("__score") >= 0.5).cast("int")
    return out.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), predicted.alias("predicted"), F.col("__rules").alias("rules"))
