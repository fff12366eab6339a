"""Hard negatives by a multiway hyperplane tree (GNAT): rows of another label that score nearly as much as a positive.

Components become integers, floor(SCALE * x); a score is the integer inner product with the anchor.  To make
scores distances, each vector x gets one more coordinate, sqrt(M - |x|**2) with M the largest |x|**2, and an anchor gets 0:
then |anchor - x|**2 = |anchor|**2 + M - 2 * score, so a window of scores is an annulus around the anchor.

A node of the tree has FANOUT split points; a vector belongs to the nearest one (whose cell is bounded by hyperplanes).
For each split point i and sibling subtree j the node knows the least and largest distance from i to the vectors in j.
By the triangle inequality a query at distance d from i finds j's vectors between max(lo - d, d - hi) and
d + hi away; where this range and the window's annulus do not meet, the subtree is skipped.  Leaves are scanned exactly.

The split points come from a sample of at most SAMPLE_ROWS vectors (those with the least hash) and the tree grows
until a leaf holds about LEAF_ROWS vectors; all vectors are then put into leaves and all of them shape the ranges, so no result
depends on the sample.  Tree and ranges have a fixed bound (SAMPLE_ROWS), and only they pass through the driver.

Queries are packed by neighbouring leaves, at most about PACK_ROWS to a pack; a leaf goes to a pack if a query in it may need it.
A pack's leaves are dealt over several tasks; each keeps its pack's queries with their best rows so far, streams
the vectors leaf by leaf, and skips a leaf for every query whose window, as narrowed by what it already holds, does not meet it.
Positives are searched twice: in the queries' own leaves for a lower bound, then everywhere under that bound.

Equal vectors of one label are one point with its `keep` smallest ids, which is all that any result can name, so copies
cost nothing.  Rows without id or label, without a vector or with a null or non-finite component take no part, nor do vectors
with |x|**2 of 2**62 or more after scaling, whose scores need not fit a long.  Exactly repeated rows (id, label,
vector) count once; rows of one id that differ are rows of their own, and an anchor's own row is never its positive.
A shorter vector is padded with zeros.  Other columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundswell.plans.shared import materialize, parallelism, ship_package

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
FANOUT, LEAF_ROWS, SAMPLE_ROWS, PACK_ROWS, TASK_ROWS, TILE = 8, 2048, 8192, 2048, 1 << 16, 512
LEAST, MOST = -(1 << 62), 1 << 62


# ---- points -----------------------------------------------------------------


def usable(rows: DataFrame, id: str, vector: str, label: Column) -> DataFrame:
    """Distinct `(id, label, q)` of the rows that take part; `q` holds the scaled components."""
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.select(F.col(id).alias("id"), label.alias("label"), F.when(sound, x).alias("x"))
    rows = rows.where("id is not null and label is not null and x is not null")
    scaled = rows.select("id", "label", F.transform("x", lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("q"))
    length = F.aggregate("q", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    return scaled.where(length < float(MOST)).distinct()


def points(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each label and vector: `pid, label, q, ids`, the `keep` smallest ids in order."""
    # Spark keeps only the first rows of each group before it shuffles, so a vector that owns a third of the rows is no hot key.
    first = F.row_number().over(Window.partitionBy("label", "q").orderBy("id"))
    least = rows.withColumn("_n", first).where(F.col("_n") <= keep)
    grouped = least.groupBy("label", "q").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return materialize(grouped.withColumn("pid", F.monotonically_increasing_id()), "points")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` integers; shorter vectors are padded."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    if len(flat) == width * len(column) and (offsets == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), offsets)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(offsets) - offsets, offsets)
    out[row, place] = flat
    return out


# ---- the tree ---------------------------------------------------------------


@dataclass
class Tree:
    """Node n has split points `splits[n]` (lifted) and `children[n]`: a node, or -1 - leaf."""

    width: int
    largest: int  # M
    splits: list[np.ndarray]
    children: list[list[int]]
    leaves: int
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None

    @cached_property
    def parents(self) -> dict[int, tuple[int, int]]:
        return {-1 - below: (node, j) for node, children in enumerate(self.children) for j, below in enumerate(children) if below < 0}

    def lifted(self, q: np.ndarray) -> np.ndarray:
        x = q.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.largest - (x * x).sum(axis=1)))])

    @property
    def slack(self) -> float:
        """Far more than distances can be off by rounding, far less than anything prunes by."""
        return 1e-6 * (1 + self.largest) ** 0.5

    def place(self, q: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """Leaf of each vector, and for each node passed `(node, rows, child number, distances to its split points)`."""
        x = self.lifted(q)
        leaf, passed, open_ = np.zeros(len(q), np.int64), [], [(0, np.arange(len(q)))]
        while open_:
            node, rows = open_.pop()
            if not len(rows):
                continue
            d = distances(x[rows], self.splits[node])
            child = d.argmin(axis=1)
            passed.append((node, rows, child, d))
            for j, below in enumerate(self.children[node]):
                mine = rows[child == j]
                if below < 0:
                    leaf[mine] = -1 - below
                else:
                    open_.append((below, mine))
        return leaf, passed

    def annuli(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lifted queries, and the least and largest distance that a score in `[low, high]` means."""
        x = q.astype(np.float64)
        own = (x * x).sum(axis=1) + self.largest
        inner_ = np.sqrt(np.maximum(0.0, own - 2.0 * high)) - self.slack
        outer = np.sqrt(np.maximum(0.0, own - 2.0 * low)) + self.slack
        return np.column_stack([x, np.zeros(len(x))]), inner_, outer

    def meets(self, node: int, at: np.ndarray, inner_: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """For each query and child of the node whether the child's ranges leave room for the query's annulus."""
        m = len(self.splits[node])
        d = distances(at, self.splits[node])[:, :, None]
        lo, hi = self.lo[node, :m, :m][None], self.hi[node, :m, :m][None]
        near = np.maximum(lo - d, d - hi) <= outer[:, None, None]
        return (near & (d + hi >= inner_[:, None, None])).all(axis=1)

    def visits(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each query and leaf whether the leaf may hold a score in `[low, high]`."""
        at, inner_, outer = self.annuli(q, low, high)
        out, open_ = np.zeros((len(q), self.leaves), bool), [(0, np.flatnonzero(low <= high))]
        while open_:
            node, rows = open_.pop()
            if not len(rows):
                continue
            stays = self.meets(node, at[rows], inner_[rows], outer[rows])
            for j, below in enumerate(self.children[node]):
                mine = rows[stays[:, j]]
                if below < 0:
                    out[mine, -1 - below] = True
                else:
                    open_.append((below, mine))
        return out

    def still(self, leaf: int, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The last step of `visits` for one leaf."""
        node, j = self.parents[leaf]
        return self.meets(node, *self.annuli(q, low, high))[:, j] & (low <= high)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(0.0, squares))


def grow(sample: np.ndarray, largest: int, total: int) -> Tree:
    """Split points by taking, from a few candidates, the one farthest from those taken; down to about LEAF_ROWS of `total` vectors."""
    tree = Tree(sample.shape[1], largest, [], [], 0)
    x = tree.lifted(sample)
    rng = np.random.default_rng(11)

    def node(rows: np.ndarray) -> int:
        number = len(tree.splits)
        candidates = rng.choice(rows, min(len(rows), 3 * FANOUT), replace=False)
        chosen = [int(candidates[0])]
        d = distances(x[candidates], x[chosen])[:, 0]
        while len(chosen) < FANOUT and d.max() > 0:
            chosen.append(int(candidates[d.argmax()]))
            d = np.minimum(d, distances(x[candidates], x[chosen[-1:]])[:, 0])
        tree.splits.append(x[chosen])
        tree.children.append([])
        nearest = distances(x[rows], x[chosen]).argmin(axis=1)
        for j in range(len(chosen)):
            mine = rows[nearest == j]
            if len(chosen) > 1 and len(mine) >= 2 * FANOUT and len(mine) * total > LEAF_ROWS * len(sample):
                tree.children[number].append(node(mine))
            else:
                tree.children[number].append(-1 - tree.leaves)
                tree.leaves += 1
        return number

    node(np.arange(len(sample)))
    return tree


def _fit(stored: DataFrame) -> Tree | None:
    longest = F.aggregate("q", F.lit(0).cast("long"), lambda total, v: total + v * v)
    seen = stored.agg(F.max(F.size("q")).alias("width"), F.max(longest).alias("largest"), F.count("*").alias("n")).first()
    if not seen["n"]:
        return None
    drawn = stored.orderBy(F.xxhash64("q", "label"), "pid").limit(SAMPLE_ROWS).select("q").toArrow()
    return grow(matrix(drawn.column("q").combine_chunks(), seen["width"]), int(seen["largest"]), seen["n"])


def index(stored: DataFrame, tree: Tree) -> DataFrame:
    """The points with `leaf`; fills the ranges of the tree from all of them."""
    ship_package(stored.sparkSession)
    names = stored.columns
    q_at = names.index("q")

    def place(batches):
        for batch in batches:
            leaf, _ = tree.place(matrix(batch.column(q_at), tree.width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*names, "leaf"])

    shape = (len(tree.splits), FANOUT, FANOUT)

    def measure(batches):
        lo, hi = np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            for node, _, child, d in tree.place(matrix(batch.column(0), tree.width))[1]:
                for j in np.unique(child):
                    mine = d[child == j]
                    lo[node, : d.shape[1], j] = np.minimum(lo[node, : d.shape[1], j], mine.min(axis=0))
                    hi[node, : d.shape[1], j] = np.maximum(hi[node, : d.shape[1], j], mine.max(axis=0))
        slot = np.flatnonzero(hi.ravel() >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(lo.ravel()[slot]), pa.array(hi.ravel()[slot])], ["slot", "lo", "hi"])

    placed = materialize(stored.mapInArrow(place, T.StructType([*stored.schema.fields, T.StructField("leaf", T.LongType())])), "placed-points")
    ranges = stored.select("q").mapInArrow(measure, "slot long, lo double, hi double").groupBy("slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    tree.lo, tree.hi = np.full(shape, np.inf), np.full(shape, -np.inf)
    slot = ranges.column("slot").to_numpy()
    tree.lo.ravel()[slot], tree.hi.ravel()[slot] = ranges.column("lo").to_numpy(), ranges.column("hi").to_numpy()
    return placed


# ---- searching --------------------------------------------------------------


def packs(queries: DataFrame, tree: Tree) -> DataFrame:
    """Add `pack`: runs of neighbouring leaves with about PACK_ROWS queries; a leaf with more is cut by hash."""
    sizes = {r["leaf"]: r["n"] for r in queries.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # at most one row per leaf
    rows, number, filled = [], 0, 0
    for leaf in range(tree.leaves):
        n = sizes.get(leaf, 0)
        if filled and filled + n > PACK_ROWS:
            number, filled = number + 1, 0
        cuts = max(1, -(-n // PACK_ROWS))
        rows.append((leaf, number, cuts))
        filled += n
        if cuts > 1:
            number, filled = number + cuts, 0
    table = F.broadcast(queries.sparkSession.createDataFrame(rows, "leaf long, _first long, _cuts long"))
    cut = F.pmod(F.xxhash64("pid"), F.col("_cuts"))
    return queries.join(table, "leaf").withColumn("pack", F.col("_first") + cut).drop("_first", "_cuts")


class Best:
    """The best rows of every window of a pack: `(score, id, pid)` by falling score, then id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, owner: np.ndarray, keep: int):
        self.low, self.high, self.owner, self.keep = low, high, owner, keep
        self.window = np.empty(0, np.int64)
        self.score, self.id, self.pid = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = low.copy()

    def add(self, window: np.ndarray, score: np.ndarray, id: np.ndarray, pid: np.ndarray) -> None:
        if not len(window):
            return
        w, s = np.concatenate([self.window, window]), np.concatenate([self.score, score])
        i, p = np.concatenate([self.id, id]), np.concatenate([self.pid, pid])
        order = np.lexsort((p, i, -s, w))
        w, s, i, p = w[order], s[order], i[order], p[order]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        place = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
        kept = place < self.keep
        self.window, self.score, self.id, self.pid = w[kept], s[kept], i[kept], p[kept]
        full = place == self.keep - 1
        self.floor[w[full]] = s[full]  # equal scores may still win by a smaller id

    def bounds(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of use to each of n queries."""
        low, high = np.full(n, MOST), np.full(n, LEAST)
        np.minimum.at(low, self.owner, self.floor)
        np.maximum.at(high, self.owner, self.high)
        return low, high


def search(queries: DataFrame, placed: DataFrame, tree: Tree, keep: int, same_label: bool, own_leaf: bool = False) -> DataFrame:
    """`(pid, window, score, id, point)`: for each window of each query the best `keep` rows of the same or of another label.

    `queries` has `pid, label, q, leaf, windows`, an array of `(lo, hi)`; an empty window is allowed. With `own_leaf` only the query's leaf is searched.
    The tasks' best rows still have to be merged by `window`.
    """
    spark = placed.sparkSession
    ship_package(spark)
    packed = materialize(packs(queries, tree).select("pack", "pid", "label", "q", "leaf", "windows"), "packed-queries")

    def bounds(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Queries' vectors, and their windows' low, high and owner."""
        windows = batch.column("windows")
        flat = windows.flatten()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(windows.offsets.to_numpy()))
        low, high = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        return matrix(batch.column("q"), tree.width), low, high, owner

    def wanted(best: Best, q: np.ndarray, home: np.ndarray) -> np.ndarray:
        if own_leaf:
            return home[:, None] == np.arange(tree.leaves)[None]
        return tree.visits(q, *best.bounds(len(q)))

    def needed(batches):
        for batch in batches:
            pack = batch.column("pack").to_numpy()
            for at in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(at, PACK_ROWS)
                q, low, high, owner = bounds(part)
                hit = wanted(Best(low, high, owner, keep), q, part.column("leaf").to_numpy())
                pairs = np.unique(np.column_stack([np.repeat(pack[at : at + PACK_ROWS], hit.sum(axis=1)), np.nonzero(hit)[1]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["pack", "leaf"])

    wants = materialize(packed.mapInArrow(needed, "pack long, leaf long").distinct(), "packs-and-leaves")
    size = wants.agg(F.count_distinct("pack").alias("packs")).first()["packs"]
    if not size:
        return spark.createDataFrame([], "pid long, window long, score long, id long, point long")
    n = placed.count()
    lanes = max(-(-n // TASK_ROWS), -(-parallelism(spark) // size))
    lane = F.pmod(F.xxhash64("pid"), F.lit(lanes))
    vectors = placed.join(wants, "leaf").select(
        "pack", lane.alias("lane"), "leaf", F.lit(None).cast("array<struct<lo:long,hi:long>>").alias("windows"), "pid", "label", "q", "ids"
    )
    asking = packed.join(wants.select("pack").distinct(), "pack", "left_semi").select(
        "pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), "leaf", "windows", "pid", "label", "q",
        F.lit(None).cast(placed.schema["ids"].dataType).alias("ids"),
    )
    both = asking.unionByName(vectors).repartition(max(parallelism(spark), min(size * lanes, 4 * parallelism(spark))), "pack", "lane")
    both = both.sortWithinPartitions("pack", "lane", F.col("windows").isNull(), "leaf")

    def run(batches):
        now, best, held = None, None, []
        q = labels = visits = pids = first_window = None

        def finish() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.window):
                number = best.window - first_window[best.owner[best.window]]
                columns = [pids[best.owner[best.window]], number, best.score, best.id, best.pid]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pid", "window", "score", "id", "point"])

        for batch in batches:
            keys = list(zip(batch.column("pack").to_pylist(), batch.column("lane").to_pylist(), batch.column("windows").is_null().to_pylist(), batch.column("leaf").to_pylist()))
            at = 0
            while at < len(keys):
                # A stretch of one pack's queries, or of its vectors of one leaf.
                pack, lane, vectors, leaf = keys[at]
                stop = at
                while stop < len(keys) and keys[stop][:3] == keys[at][:3] and (not vectors or keys[stop][3] == leaf):
                    stop += 1
                part, at = batch.slice(at, stop - at), stop
                if now != (pack, lane):
                    yield from finish()
                    now, best, held = (pack, lane), None, []
                if not vectors:
                    held.append(part)
                    continue
                if best is None:
                    asked = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                    q, low, high, owner = bounds(asked)
                    best = Best(low, high, owner, keep)
                    first_window = np.searchsorted(owner, np.arange(len(q)))
                    pids, home = asked.column("pid").to_numpy(), asked.column("leaf").to_numpy()
                    labels = np.array(asked.column("label").to_pylist(), object)
                    visits = wanted(best, q, home)
                rows = np.flatnonzero(visits[:, leaf])
                if not own_leaf:  # with the windows as they are by now
                    low, high = best.bounds(len(q))
                    rows = rows[tree.still(leaf, q[rows], low[rows], high[rows])]
                for start in range(0, part.num_rows if len(rows) else 0, TILE):
                    _scan(part.slice(start, TILE), q, labels, rows, best, tree.width, same_label)
        yield from finish()

    return both.mapInArrow(run, "pid long, window long, score long, id long, point long")


def _scan(part: pa.RecordBatch, q: np.ndarray, labels: np.ndarray, rows: np.ndarray, best: Best, width: int, same_label: bool) -> None:
    """Scores of some queries against a tile of vectors; what falls into a window is kept if it is among the best."""
    x = matrix(part.column("q"), width)
    asked = q[rows]
    scores = inner(asked, x)
    low, high = best.bounds(len(q))
    row, col = np.nonzero((scores >= low[rows][:, None]) & (scores <= high[rows][:, None]))
    theirs = np.array(part.column("label").to_pylist(), object)
    fits = (labels[rows[row]] == theirs[col]) == same_label
    row, col = row[fits], col[fits]
    if not len(row):
        return
    score, query = scores[row, col], rows[row]
    # Every window of those queries, then only those that the score is in.
    first, last = np.searchsorted(best.owner, query), np.searchsorted(best.owner, query, side="right")
    copies = last - first
    window = np.repeat(first, copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    score, col = np.repeat(score, copies), np.repeat(col, copies)
    fits = (score >= best.floor[window]) & (score <= best.high[window])
    window, score, col = window[fits], score[fits], col[fits]
    ids = part.column("ids")
    starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    copies = (starts[1:] - starts[:-1])[col]
    place = np.repeat(starts[:-1][col], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    best.add(np.repeat(window, copies), np.repeat(score, copies), flat[place], np.repeat(part.column("pid").to_numpy()[col], copies))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while every sum stays below 2**53, else in whole numbers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def merged(found: DataFrame, keep: int) -> DataFrame:
    """The best `keep` of what the tasks found for each window."""
    rank = F.row_number().over(Window.partitionBy("pid", "window").orderBy(F.desc("score"), "id", "point"))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep)


def hard_negatives(
    rows: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    `anchor` says, of the column `id`, which rows are anchors.  Each anchor is paired with its best `positives` rows of the same label and each pair
    with the best `negatives` rows of another label whose score is between `low` and `high` percent of the positive's.  Higher scores come first,
    ties by smaller id.
    """
    known = materialize(usable(rows, id, vector, F.col("label") if label is None else label), "vectors")
    stored = points(known, max(positives + 1, negatives))
    tree = _fit(stored)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if tree is None:
        return rows.sparkSession.createDataFrame([], schema)
    placed = index(stored, tree)
    # An anchor's point: a point has one row, so copies of one vector among the anchors are a skewed join at most.
    named = known.select(F.col("id").alias(id), "label", "q").where(anchor).withColumnRenamed(id, "anchor_id")
    anchors = materialize(named.join(placed.select("label", "q", "pid"), ["label", "q"]).select("anchor_id", "pid"), "anchors")
    asked = placed.join(anchors.select("pid").distinct(), "pid", "left_semi").select("pid", "label", "q", "leaf")

    def window(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    everything = asked.withColumn("windows", F.array(window(F.lit(LEAST), F.lit(MOST))))
    near = merged(search(everything, placed, tree, positives + 1, True, own_leaf=True), positives + 1)
    floor = near.where(F.col("rank") == positives + 1).select("pid", F.col("score").alias("_floor"))
    bounded = asked.join(floor, "pid", "left").withColumn("windows", F.array(window(F.coalesce("_floor", F.lit(LEAST)), F.lit(MOST)))).drop("_floor")
    best = merged(search(bounded, placed, tree, positives + 1, True), positives + 1)
    best = materialize(best.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id", "point"))).alias("found")), "positives")

    # A window for each score that a positive of the point can have.
    scores = F.array_distinct(F.transform("found", lambda f: f["score"]))
    numbered = best.select("pid", F.posexplode(scores).alias("window", "positive_score"))
    exact = lambda p: window(-F.floor((-p * low).cast("decimal(38,0)") / 100), F.floor((p * high).cast("decimal(38,0)") / 100))
    windows = best.select("pid", F.transform(scores, lambda p: exact(p.cast("decimal(38,0)"))).alias("windows"))
    hard = merged(search(asked.join(windows, "pid"), placed, tree, negatives, False), negatives)
    hard = hard.join(numbered, ["pid", "window"]).select("pid", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))

    others = F.filter("found", lambda f: (f["id"] != F.col("anchor_id")) | (f["point"] != F.col("pid")))
    pairs = anchors.join(best, "pid").select("anchor_id", "pid", F.explode(F.slice(others, 1, positives)).alias("p"))
    pairs = pairs.select("anchor_id", "pid", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return pairs.join(hard, ["pid", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
