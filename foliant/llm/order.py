"""Places in a global order, found without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import fresh, hot_join, stage

#: Rows of a small side that a join may broadcast.
SMALL = 100_000


def placed(rows: DataFrame, by: list, group: str | None = None) -> DataFrame:
    """`rows` with `position` (from 0) by the columns `by` within `group`, and `members`, the group's rows.

    group: a column that is never null and leads the order; None: all rows are one group. Rows are dealt by ranges of all
    the order's columns, so a hot group is spread; a task numbers its own range, and what precedes a range within a
    group is a sum over at most one row for each task and group. `rows` is read twice: give it staged. Nulls come
    first; rows equal in all of `by` are told apart arbitrarily. An empty table stays empty.
    """
    at, part, first, key = fresh(rows.columns, "__at", "__part", "__first", "__key")
    lead = F.lit("") if group is None else F.col(group)
    order = [*([] if group is None else [F.col(group)]), *(F.col(c) if isinstance(c, str) else c for c in by)]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    dealt = stage(dealt.withColumn(part, F.shiftright(F.col(at), 33)).withColumn(key, lead), "placed")
    spans = stage(dealt.groupBy(key, part).agg(F.min(at).alias(first), F.count("*").alias("__rows")), "spans")
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(key, part, first, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy(key)).alias("members"))
    if spans.count() <= SMALL:
        spans = F.broadcast(spans)
    joined = dealt.join(spans, [key, part])
    return joined.select(*(dealt[f"`{c}`"] for c in rows.columns), (F.col(at) - F.col(first) + F.col("__before")).alias("position"), "members")


def looked_up(left: DataFrame, right: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """`left` joined with `right`, one row a key: broadcast while small, else dealt with hot keys apart (`hot_join`)."""
    if right.count() <= SMALL:
        return left.join(F.broadcast(right), on)
    return hot_join(left, right, on, size, total)
