"""SimHash fingerprints, and near-duplicate groups by a self-join of binary tries.

Fingerprints at most `budget` bits apart are linked.  The 64 bits are cut into
`budget + AGREE` blocks; two linked fingerprints agree in at least AGREE of them,
so every pair meets in one of the *shards* (a choice of AGREE blocks and their
value).  A shard is the set of leaves of a binary trie over the fingerprint
bits.  The trie is joined with itself from the root: pairs of nodes are opened
together, their differing bits add up, a pair over the budget is dropped, and so
is a pair whose leaves are already known to be one group.  Pairs that reach the
leaves become links of a spanning forest: no list of all pairs is ever made.

Skew: equal fingerprints are one row before the join, so copies cost nothing.  A
shard with more than `shard_rows` fingerprints is dealt into chunks, and every
two chunks meet in a task of their own (the trie of one against the trie of the
other), so no task holds more than two chunks.

Groups come from the links by repeated exchange of the smallest label, each
round written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundswell.llm.frames import annotate, encoded, fresh
from groundswell.plans.shared import materialize, parallelism, ship_package

BITS, BUDGET, SHINGLE, SEED, AGREE = 64, 4, 4, 42, 2
SHARD_ROWS = 512
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half the shingle hashes; zero without words."""
    words = text.translate(_LOWER).split()  # ASCII white space: \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())], ">u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", keep=None, shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint as a signed long with the same bits. Null text has no words."""

    def make():
        def work(texts):
            prints = np.array([fingerprint(t, shingle) for t in encoded(texts)], np.uint64)
            return [pa.array(prints.view(np.int64))]

        return work

    return annotate(docs, text, [T.StructField(name, T.LongType())], make, keep)


def blocks(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks of a fingerprint."""
    n = budget + AGREE
    edges = [round(BITS * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shards(prints: DataFrame, budget: int, shard_rows: int) -> DataFrame:
    """Rows `(_shard, _pair, _side, fp)`: every chunk pair of every shard with at least two fingerprints."""
    keys = []
    for number, chosen in enumerate(combinations(blocks(budget), AGREE)):
        parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in chosen]
        keys.append(F.struct(F.lit(number).alias("c"), parts[0].alias("x"), parts[1].alias("y")))
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("_shard")).select("fp", "_shard.*")
    # Fingerprints that share a shard fall into it in arrival order; chunks are drawn by a hash of the fingerprint.
    sizes = rows.groupBy("c", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["c", "x", "y"])
    chunks = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    rows = rows.withColumn("k", chunks).withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("_other")
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return rows.select("c", "x", "y", "_own", "fp", other).select("c", "x", "y", low.alias("i"), high.alias("j"), (F.col("_own") == high).alias("right"), "fp")


def trie_join(groups: np.ndarray, right: np.ndarray, self_join: np.ndarray, fps: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the pairs within the budget, for many shards at once.

    Rows are sorted by (group, right, fp).  A node is a range of rows that share a
    prefix; a pair of nodes is (left range, right range, differing bits so far).
    """
    if not len(fps):
        return []
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    # Root pairs: a group's whole trie with itself, or its left chunk's trie with its right chunk's.
    first = np.flatnonzero(np.diff(groups, prepend=-1))
    last = np.append(first[1:], len(groups))
    middle = np.array([a + int(np.searchsorted(right[a:b], True)) for a, b in zip(first, last)], np.int64)
    own = self_join[first]
    a0, a1 = first, np.where(own, last, middle)
    b0, b1 = np.where(own, first, middle), last
    stack = [(0, np.column_stack([a0, a1, b0, b1, np.zeros(len(first), np.int64)]))]
    while stack:
        bit, pairs = stack.pop()
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget)]
        pairs = pairs[~((pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1))]
        if not len(pairs):
            continue
        if len(pairs) > 65536:  # depth first in bounded pieces
            half = len(pairs) // 2
            stack += [(bit, pairs[half:]), (bit, pairs[:half])]
            continue
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if single.any():
            # Two leaves: the remaining bits in one step.
            left, rest = pairs[single, 0], pairs[single, 2]
            near = np.bitwise_count(fps[left] ^ fps[rest]) <= budget
            for i, j in zip(left[near].tolist(), rest[near].tolist()):
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((i, j))
            pairs = pairs[~single]
        if not len(pairs) or bit == BITS:
            continue
        cut = np.uint64(1 << (BITS - 1 - bit))
        mask = (fps & cut) != 0
        below = np.concatenate([[0], np.cumsum(mask)])  # ones before each row; inside a node, zeros come first

        def split(lo, hi):
            return hi - (below[hi] - below[lo])

        am, bm = split(pairs[:, 0], pairs[:, 1]), split(pairs[:, 2], pairs[:, 3])
        same = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3])
        d = pairs[:, 4]
        opened = np.concatenate(
            [
                np.column_stack([pairs[:, 0], am, pairs[:, 2], bm, d]),
                np.column_stack([am, pairs[:, 1], bm, pairs[:, 3], d]),
                np.column_stack([pairs[:, 0], am, bm, pairs[:, 3], d + 1]),
                np.column_stack([am, pairs[:, 1], pairs[:, 2], bm, d + 1])[~same],
            ]
        )
        stack.append((bit + 1, opened))
    return links


def links(prints: DataFrame, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links `(a, b)` between distinct fingerprints (`fp` of `prints`) whose groups are those of all near pairs."""
    ship_package(prints.sparkSession)
    keys = ["c", "x", "y", "i", "j"]
    dealt = shards(prints, budget, shard_rows).repartition(parallelism(prints.sparkSession), *keys)
    dealt = dealt.sortWithinPartitions(*keys, "right", F.expr("fp < 0"), "fp")

    def join(table: pa.Table):
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        right = table.column("right").to_numpy()
        fps = table.column("fp").to_numpy().view(np.uint64)
        found = trie_join(np.cumsum(change), right, columns[3] == columns[4], fps, budget)
        ends = np.array(found, np.int64).reshape(-1, 2)
        signed = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[ends[:, 0]]), pa.array(signed[ends[:, 1]])], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Up to the last key of the batch everything is complete; that key may go on.
            final = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            open_ = np.ones(batch.num_rows, bool)
            for k, v in zip(keys, final):
                open_ &= batch.column(k).to_numpy(zero_copy_only=False) == v
            start = int(np.argmax(open_))
            if held and start == 0 and [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys] == final:
                held.append(batch)
                continue
            if held or start:
                yield join(pa.Table.from_batches([*held, batch.slice(0, start)]).combine_chunks())
            held = [batch.slice(start)]
        if held:
            yield join(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`(node, label)`: the smallest node that links reach, for every node that has a link.

    Alternates between hanging every larger neighbour, then every smaller one,
    below the smallest neighbour, until nothing changes: about log(longest path)
    rounds.  Each round is written to the shared folder.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = materialize(now, "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "links-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = materialize(small.select("e.*").where("u <> v").distinct(), "links-small")
        if small.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(small, ["u", "v"], "left_anti").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                small.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        now = small


def _grouped(docs: DataFrame, id: str, text: str, budget: int, shingle: int, shard_rows: int) -> DataFrame:
    """`(id, fp, label, component_id)` for every row; `label` names the group, `component_id` is its smallest id."""
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = materialize(with_fingerprints(slim, "text", "fp", ["id"], shingle), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    labels = components(links(prints, budget, shard_rows))
    grouped = prints.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    grouped = materialize(grouped, "fingerprint-groups")
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "label").select("fp", "label", "component_id")
    return rows.join(named, "fp").select("id", "fp", "label", "component_id")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`(id, _fp, component_id)` for every row: its fingerprint and the smallest id of its group.

    A null id takes part in its group but is never its smallest; a group of null
    ids alone has a null component.  Repeated rows are returned as often as they occur.
    """
    rows = _grouped(docs, id, text, budget, shingle, shard_rows)
    return rows.select(F.col("id").alias(id), F.col("fp").alias("_fp"), "component_id")


def hex64(column) -> "F.Column":
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of the keys: the least by its other columns, in their order."""
    others = [c.name for c in rows.schema if c.name not in keys and not isinstance(c.dataType, (T.MapType, T.VariantType))]
    place = fresh(rows, "_place")
    order = Window.partitionBy(*keys).orderBy(*(others or keys))
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)


def one_per_group(
    docs: DataFrame, id: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The row with the smallest id of every group, with its own columns.

    Rows that share an id but not a group stand for their groups each.  Of rows that share both, the one with the smallest
    fingerprint stays, then the least by its columns.  Rows without an id cannot be named by a group; they are kept and stand for nobody.
    """
    named = docs.where(F.col(id).isNotNull())
    rows = materialize(_grouped(named, id, text, budget, shingle, shard_rows), "groups")
    heads = rows.where(F.col("id") == F.col("component_id")).groupBy("label").agg(F.min(F.struct("id", "fp")).alias("head"))
    heads = materialize(heads.select(F.col("head.id").alias(id), F.col("head.fp").alias("_head")), "heads")
    # Where an id has one text only, which is the rule, the id says all; the others' rows are told apart by their fingerprints.
    several = materialize(rows.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select(F.col("id").alias(id)), "shared-ids")
    plain = named.join(heads.select(id).distinct(), id, "left_semi").join(several, id, "left_anti")
    mark = fresh(named, "_fp")
    mixed = with_fingerprints(named.join(several, id, "left_semi"), text, mark, shingle=shingle)
    mixed = mixed.join(heads.withColumnRenamed("_head", mark), [id, mark], "left_semi")
    return _first(plain, [id]).unionByName(_first(mixed, [id, mark]).select(*docs.columns)).unionByName(docs.where(F.col(id).isNull()))
