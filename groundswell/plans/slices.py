"""Ordered work over a key without putting the whole key into one task.

`Window.partitionBy(robot)` sends every row of a robot to one task, which does
not survive a robot that owns a third of the data.  Here a key's rows are cut
into time slices; a window runs inside each slice, and only one summary row per
slice travels along the whole key to carry values over the cuts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundswell.functions.columns import time_bin

SLICE_S = 3600
# Rows that one piece should not much exceed; every slice is cut by its own count.
PIECE_ROWS = 4_000_000
LEVELS = 32  # of a binary tree over days: more days than timestamps have
SLICE = ["_start", "_instant", "_block"]


def sliced(
    df: DataFrame, keys: Sequence[str], start: Column, ts: str = "ts", tie: str = "seq", slice_s: float = SLICE_S
) -> DataFrame:
    """Add the piece (`_start, _instant, _block`) of each row, in the order of `(ts, tie)`.

    A slice of n rows is cut into n / PIECE_ROWS equal spans of time (`_instant`).  Where
    the rows crowd inside a span, so that it still holds over twice PIECE_ROWS, it is cut at
    its instants and, within one instant, by blocks of arrival (`_block`).  Slices
    that need no cut are not listed; the two lists have at most rows / PIECE_ROWS entries
    (250,000 for 10**12 rows), so they are broadcast whatever the optimizer thinks of their size.
    """
    rows = df.withColumn("_start", start)
    large = (
        rows.groupBy(*keys, "_start")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > PIECE_ROWS)
        .select(*keys, "_start", F.ceil(F.col("_n") / F.lit(PIECE_ROWS)).alias("_cuts"))
    )
    into = F.unix_micros(ts) - F.unix_micros("_start")
    span = F.floor(into * F.col("_cuts") / F.lit(int(slice_s * 1_000_000)))
    rows = rows.join(F.broadcast(large), [*keys, "_start"], "left").withColumn("_instant", F.when(F.col("_cuts").isNotNull(), span))
    crowded = (
        rows.where(F.col("_instant").isNotNull())
        .groupBy(*keys, "_start", "_instant")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > 2 * PIECE_ROWS)
        .select(*keys, "_start", "_instant", F.lit(True).alias("_crowded"))
    )
    # Offset in the slice above the block of arrival, in one number.
    block = F.shiftleft(into, 31) + F.floor(F.col(tie) / F.lit(PIECE_ROWS)).cast("long")
    return (
        rows.join(F.broadcast(crowded), [*keys, "_start", "_instant"], "left")
        .withColumn("_block", F.when(F.col("_crowded"), block))
        .select(*df.columns, *SLICE)
    )


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    ts: str = "ts",
    tie: str = "seq",
    slice_s: int = SLICE_S,
    inclusive: bool = False,
) -> DataFrame:
    """Add, per name, the last non-null value among the key's earlier rows.

    Order is `(ts, tie)`.  With `inclusive` the row itself counts as well.  The
    rows are shuffled once, on (key, slice); the slice tails carry the rest.
    """
    names = list(values)
    rows = df.select("*", *[values[n].alias(f"_v_{n}") for n in names])
    rows = sliced(rows, keys, time_bin(ts, slice_s), ts, tie, slice_s)
    order = F.struct(ts, tie)
    tails = rows.groupBy(*keys, *SLICE).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), order)).alias(f"_v_{n}") for n in names]
    )
    earlier = Window.partitionBy(*keys).orderBy(*SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys, *SLICE, F.lit(True).alias("_carried"),
        *[F.last(f"_v_{n}", ignorenulls=True).over(earlier).alias(f"_v_{n}") for n in names],
    )
    everything = rows.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    ordered = Window.partitionBy(*keys, *SLICE).orderBy(F.desc("_carried"), ts, tie)
    frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        everything.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(frame).alias(n) for n in names])
        .where(~F.col("_carried"))
        .select(*df.columns, *names)
    )


DAY_S = 86_400


def first_after(points: DataFrame, marks: DataFrame, slice_s: int = SLICE_S, group_s: int = DAY_S) -> DataFrame:
    """For each distinct `at` of `points`, the first `(at, seq)` of `marks` strictly later.

    Returns `at, mark_at, mark_seq`; points that no mark follows are absent.  Both
    sides shrink to distinct milliseconds first, so a slice holds at most
    `2000 * slice_s` rows however many requests it stands for.

    The first mark of what lies behind a slice is found on two levels: among the slices of its group (a day), and, for
    a group's last slices, among the groups that have a mark, each of which only asks for the nearest one after it.
    """
    marks = (
        marks.groupBy(F.unix_millis("at").alias("_ms"))
        .agg(F.min("seq").alias("_seq"))
        .select("_ms", F.struct(F.col("_ms"), F.col("_seq")).alias("_mark"))
    )
    points = points.select(F.unix_millis("at").alias("_ms")).distinct()
    both = points.unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_slice", F.floor(F.col("_ms") / F.lit(slice_s * 1000)))
    both = both.withColumn("_group", F.floor(F.col("_slice") * slice_s / F.lit(group_s)))
    heads = both.groupBy("_group", "_slice").agg(F.min("_mark").alias("_head"))
    later = Window.partitionBy("_group").orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    within = heads.select("_group", "_slice", F.first("_head", ignorenulls=True).over(later).alias("_mark"))
    beyond = _next_group(heads.groupBy("_group").agg(F.min("_head").alias("_head")))
    heads = within.join(beyond, "_group", "left").select("_slice", F.coalesce("_mark", "_beyond").alias("_mark"))
    everything = both.drop("_group").withColumn("_tail", F.lit(False)).unionByName(
        heads.withColumn("_tail", F.lit(True)), allowMissingColumns=True
    )
    # Backwards in time; at equal times a point comes before a mark, so "strictly later" holds.
    backwards = (
        Window.partitionBy("_slice")
        .orderBy(F.desc("_tail"), F.desc("_ms"), F.col("_mark").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        everything.withColumn("_next", F.last("_mark", ignorenulls=True).over(backwards))
        .where(~F.col("_tail") & F.col("_mark").isNull() & F.col("_next").isNotNull())
        .select(
            F.timestamp_millis("_ms").alias("at"),
            F.timestamp_millis("_next._ms").alias("mark_at"),
            F.col("_next._seq").alias("mark_seq"),
        )
    )


def _next_group(groups: DataFrame) -> DataFrame:
    """`(_group, _beyond)`: the head of the nearest later group that has one.

    Numbers are cut into aligned blocks of 1, 2, 4, ... groups (a binary tree of LEVELS levels).  What lies behind a group is
    the union of at most LEVELS such blocks, so each group looks its blocks up by an equi-join and takes the least head:
    rows meet by block, and no window runs over all of them.
    """
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    number = F.col("_group") + F.lit(1 << LEVELS - 1)  # none is negative, so all have one root
    block = lambda k: F.call_function("shiftright", number, k)
    kept = groups.where(F.col("_head").isNotNull())
    tree = kept.select(F.explode(F.transform(levels, lambda k: F.struct(k.alias("k"), block(k).alias("b")))).alias("n"), "_head")
    tree = tree.groupBy("n").agg(F.min("_head").alias("_head"))
    # To the right of a path from the leaf: at every level where the path goes left, the sibling.
    behind = F.filter(levels, lambda k: block(k) % 2 == 0)
    asks = groups.select("_group", F.explode(F.transform(behind, lambda k: F.struct(k.alias("k"), (block(k) + 1).alias("b")))).alias("n"))
    return asks.join(tree, "n").groupBy("_group").agg(F.min("_head").alias("_beyond"))
