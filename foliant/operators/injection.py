"""Figures' references put before the lines of a page that read like their captions.

A page's captions are few; their letter pairs are the index that its lines are looked up in. Equal and contained
captions are settled by comparison; of the other lines, lengths, shared letter pairs and shared letters rule out all that
cannot reach the likeness asked for, and only what is left is measured. Which line a figure takes depends on the
figures before it, so a fold over the page's figures decides, with the page's order of lines as its state.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let, lines, strip
from foliant.operators.figures import caption_key, clear_positions

#: The least likeness of a caption and its line, and that of one that holds the other.
LEAST, HELD = 0.72, 0.95
#: Two texts of 13 letters or more in all share a letter pair if they are as alike as LEAST: of matching blocks there is at
#: most one more than of letters that match nothing, and each letter of a block but its last begins a pair. Of texts
#: with fewer in all, neither has more letters than this, and their single letters are in the index too.
SHORT = 7
CANDIDATE = "array<struct<figure:int,line:int,score:double,text:string,caption:string>>"


def grams(text: Column) -> Column:
    """The letter pairs of a text; of a short one, its letters too."""
    n = F.length(text)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.when(n.between(1, SHORT), F.concat(pairs, letters(text))).otherwise(pairs)


def letters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)))


def shared_letters(a: Column, b: Column) -> Column:
    """How many letters two texts have in common, each as often as the one that has fewer of it."""
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, sign, F.lit("")))
    return F.aggregate(F.array_distinct(letters(b)), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def may_be_alike(text: Column, caption: Column, index: Column) -> Column:
    """Whether a text can have the likeness LEAST with a caption, whose grams the index holds: false only if it can't."""
    total = F.length(text) + F.length(caption)
    near = 2 * F.least(F.length(text), F.length(caption)) >= LEAST * total
    return F.when(near, F.when(F.arrays_overlap(grams(text), index), 2 * shared_letters(text, caption) >= LEAST * total).otherwise(False)).otherwise(False)


def measured(pairs: Column) -> Column:
    """How much the matching blocks of a text and a caption hold of both, for an array of pairs."""

    def run(pairs: pd.Series) -> pd.Series:
        return pairs.map(lambda some: [difflib.SequenceMatcher(None, p["text"], p["caption"]).ratio() for p in some])

    return F.pandas_udf(run, "array<double>")(pairs)


def candidates(keys: Column, captions: Column, own: Column) -> Column:
    """CANDIDATE: for each figure the lines that can be its caption's; score is null where it has to be measured.

    keys: the page's lines, `own` of them, and behind them the references of all figures, as they are compared. A figure
    meets the references of later figures alone, as these are put in before.
    """

    def of_figure(caption: Column, f: Column) -> Column:
        def of_line(index: Column) -> Column:
            def one(text: Column, line: Column) -> Column:
                score = F.when(text == caption, 1.0).when(text.contains(caption) | caption.contains(text), HELD)
                there = (text != "") & ((line < own) | (line - own > f)) & (score.isNotNull() | may_be_alike(text, caption, index))
                return F.when(there, F.struct(f.alias("figure"), line.alias("line"), score.alias("score"), text.alias("text"), caption.alias("caption")))

            return F.filter(F.transform(keys, one), lambda c: c.isNotNull())

        return F.when(caption != "", let(grams(caption), of_line)).otherwise(F.array()).cast(CANDIDATE)

    return F.flatten(F.transform(captions, of_figure))


def placed(found: Column, own: Column, figures: Column) -> Column:
    """The order of a page's lines, by their numbers, with the references between them: -1 is an empty line.

    Figures take their lines from the last to the first. A place that was taken stays taken by its number, though lines
    behind it move: the reference itself stands there from then on.
    """
    kind = "struct<order:array<int>,taken:array<int>>"

    def step(s: Column, f: Column) -> Column:
        def at(c: Column) -> Column:
            place = F.array_position(s["order"], c["line"]).cast("int") - 1
            return F.when((place >= 0) & ~F.array_contains(s["taken"], place) & (c["score"] >= LEAST), F.struct(c["score"].alias("score"), (-place).alias("back")))

        def put(best: Column) -> Column:
            place = -best["back"]
            order = F.concat(F.slice(s["order"], F.lit(1), place), F.array((own + f).cast("int"), F.lit(-1)), F.slice(s["order"], place + 1, F.size(s["order"])))
            return F.when(best.isNull(), s).otherwise(F.struct(order.alias("order"), F.array_append(s["taken"], place).alias("taken"))).cast(kind)

        return let(F.array_max(F.transform(F.filter(found, lambda c: c["figure"] == f), at)), put)

    first = F.when(own > 0, F.sequence(F.lit(0), own - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(first.alias("order"), F.array().cast("array<int>").alias("taken")).cast(kind)
    back = F.reverse(F.sequence(F.lit(0), figures - 1))
    return F.aggregate(back, start, step, lambda s: s["order"])


def inject(pages: DataFrame) -> DataFrame:
    """pages (page_id, md, figures array<struct<caption, path>>) as (page_id, md) with the figures' references.

    Each figure's reference, and an empty line, go before the line most like its caption, the first of equals, if it is
    like enough; the last figure comes first. Position marks go. A null page is an empty one; a page without
    figures stays as it is but for the marks; a null caption, or one of nothing but signs, finds no line.
    """
    given = F.coalesce("figures", F.array().cast("array<struct<caption:string,path:string>>"))
    rows = pages.select("page_id", F.coalesce("md", F.lit("")).alias("md"), F.transform(given, lambda g: F.struct(F.coalesce(g["caption"], F.lit("")).alias("caption"), F.coalesce(g["path"], F.lit("")).alias("path"))).alias("figures"))
    some = rows.where("size(figures) > 0").withColumn("lines", lines(F.col("md")))
    references = F.transform("figures", lambda g: F.concat(F.lit("!["), g["caption"], F.lit("]("), g["path"], F.lit(")")))
    some = some.withColumn("all", F.concat("lines", references)).withColumn("own", F.size("lines"))
    key = lambda t: caption_key(strip(t))
    some = some.withColumn("keys", F.transform("all", key)).withColumn("captions", F.transform("figures", lambda g: key(g["caption"])))
    some = some.withColumn("found", candidates(F.col("keys"), F.col("captions"), F.col("own")))
    some = some.withColumn("open", F.filter("found", lambda c: c["score"].isNull())).withColumn("sure", F.filter("found", lambda c: c["score"].isNotNull()))
    some = some.withColumn("scores", measured(F.transform("open", lambda c: F.struct(c["text"].alias("text"), c["caption"].alias("caption")))))
    scored = F.zip_with("open", "scores", lambda c, s: c.withField("score", s))
    some = some.withColumn("found", F.concat("sure", scored)).withColumn("order", placed(F.col("found"), F.col("own"), F.size("figures")))
    text = F.array_join(F.transform("order", lambda i: F.when(i < 0, "").otherwise(F.get("all", i))), "\n")
    done = some.select("page_id", clear_positions(text).alias("md"))
    return done.unionByName(rows.where("size(figures) = 0").select("page_id", clear_positions(F.col("md")).alias("md")))
