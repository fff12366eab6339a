"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of 13 words (a shorter item is one window), a window
into shingles of five words (a shorter window is one shingle).  A document holds
a window only if it holds all of its shingles, so the prefix that must meet is
one shingle, and the best choice is the one that is rarest in the corpus.  Steps:
(1) count every item shingle over all documents, (2) index each window under its
rarest shingle and that shingle's place in it, (3) look up the documents'
shingles; each match gives one possible place of the window, (4) drop places
that leave the document, (5) compare the words themselves.

The index is sent to the tasks in blocks of at most `block_bytes` of item text;
a larger benchmark takes several passes, whose hits are carried along in a
column and written to the shared folder between passes.  Documents are never
shuffled and no pair of documents is made, so no key can be hot.

Null texts have no words, items without words match nothing, repeated rows and
items are judged each on its own; equal item ids count once.  Other columns are
passed through.  An empty table gives an empty result; an empty benchmark, no hits.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundswell.llm.frames import encoded, fresh, slices
from groundswell.llm.words import Words, word_list
from groundswell.plans.shared import materialize, ship_package

WINDOW, SHINGLE = 13, 5
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22


def item_windows(text: bytes, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = word_list(text)
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Membership:
    """Which hashes of a long array are in a set: a bit filter, then a search."""

    def __init__(self, hashes):
        self.sorted = np.unique(np.array(list(hashes), np.uint64))
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[(self.sorted >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `h` of members, and their rank in the sorted set."""
        if not len(self.sorted):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        rank = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        true = self.sorted[rank] == h[maybe]
        return maybe[true], rank[true]


def _fitting(words: Words, k: int) -> np.ndarray:
    """Shingle hashes of width k, with 0 where the shingle would run into the next text."""
    h = words.shingles(k)
    for last in words.first[1:-1]:
        h[max(0, last - k + 1) : last] = 0
    return h


def _window_shingles(window: tuple[bytes, ...], width: int) -> list[int]:
    w = Words([b" ".join(window)])
    return w.shingles(width).tolist()


def _width(window: tuple[bytes, ...]) -> int:
    return min(SHINGLE, len(window))


def shingle_counts(docs: DataFrame, text: str, shingles: dict[int, set[int]]) -> dict[int, int]:
    """Occurrences, over all documents, of each given shingle (by width); absent ones are left out.

    Every task adds up its own counts, so what is shuffled and returned is
    bounded by the number of shingles given.
    """

    def run(batches):
        sets = {k: Membership(v) for k, v in shingles.items()}
        totals = {k: np.zeros(len(m.sorted), np.int64) for k, m in sets.items()}
        for batch in batches:
            rows = encoded(batch.column(0))
            size, part = 0, []
            for row in [*rows, None]:
                if row is not None:
                    part.append(row)
                    size += len(row)
                if part and (row is None or size > 2 << 20):
                    words = Words(part)
                    for k, m in sets.items():
                        totals[k] += np.bincount(m.find(_fitting(words, k))[1], minlength=len(m.sorted))
                    size, part = 0, []
        hashes = np.concatenate([m.sorted for m in sets.values()]).view(np.int64)
        counts = np.concatenate([totals[k] for k in sets])
        seen = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(hashes[seen]), pa.array(counts[seen])], ["h", "n"])

    if not any(shingles.values()):
        return {}
    found = docs.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {r.h & (1 << 64) - 1: r.n for r in found}


class Index:
    """Windows under their rarest shingle."""

    def __init__(self, items: list[tuple[str, bytes]], counts: dict[int, int] | None = None):
        holders: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for window in item_windows(text):
                holders[window].add(item)
        self.windows = [(w, sorted(ids)) for w, ids in holders.items()]
        self.shingles = [_window_shingles(w, _width(w)) for w, _ in self.windows]
        if counts is not None:
            self.rank(counts)

    def all_shingles(self) -> dict[int, set[int]]:
        out: dict[int, set[int]] = defaultdict(set)
        for (window, _), hashes in zip(self.windows, self.shingles):
            out[_width(window)].update(hashes)
        return dict(out)

    def rank(self, counts: dict[int, int]) -> None:
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, ((window, _), hashes) in enumerate(zip(self.windows, self.shingles)):
            place = min(range(len(hashes)), key=lambda i: (counts.get(hashes[i], 0), i))
            if counts.get(hashes[place], 0):  # a shingle that no document holds rules its window out
                self.postings[_width(window)][hashes[place]].append((number, place))
        self.postings = {k: dict(v) for k, v in self.postings.items()}

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text: its words, the word ranges of occurring windows, the items they belong to."""
        words = Words(texts)
        out = [(int(b - a), [], set()) for a, b in zip(words.first[:-1], words.first[1:])]
        for width, posted in self.postings.items():
            member = self.members[width]
            at, rank = member.find(_fitting(words, width))
            owner = np.searchsorted(words.first, at, side="right") - 1
            keys = member.sorted[rank].tolist()
            for p, key, doc in zip(at.tolist(), keys, owner.tolist()):
                low, high = int(words.first[doc]), int(words.first[doc + 1])
                for number, place in posted[key]:
                    window, ids = self.windows[number]
                    start = p - place
                    if start < low or start + len(window) > high:
                        continue
                    if all(words.word(start + i) == w for i, w in enumerate(window)):
                        out[doc][1].append((start - low, start - low + len(window)))
                        out[doc][2].update(ids)
        return out

    @property
    def members(self) -> dict[int, Membership]:
        if not hasattr(self, "_members"):
            self._members = {k: Membership(v) for k, v in self.postings.items()}
        return self._members


def covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges as disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The benchmark's items in blocks of bounded size, one block on the driver at a time."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(1, math.ceil(2 * size / block_bytes)) if size > block_bytes else 1
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).distinct()
        yield [(r.item, bytes(r.text or b"")) for r in block.toLocalIterator()], k == n - 1


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep=None,
    one_in: int = 20,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`keep` (default: all columns) of `docs`, and a struct column (see `verdict_column`) of `RESULT`.

    A document is contaminated if words of it are hit and they are at least one in `one_in` of its words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kept = list(docs.columns if keep is None else keep)
    ranges, found = fresh(docs, "_ranges"), fresh(docs, "_items")
    verdict = verdict_column(docs)
    frame, carried = docs, False
    for items, last in _blocks(benchmark, item, item_text, block_bytes):
        index = Index(items)
        index.rank(shingle_counts(docs, text, index.all_shingles()))
        sent = spark.sparkContext.broadcast(index)
        frame = _pass(frame, text, sent, ranges, found, verdict, carried, kept if last else list(docs.columns), last, one_in)
        if not last:
            frame, carried = materialize(frame, "decontamination"), True
    return frame


def verdict_column(docs: DataFrame) -> str:
    return fresh(docs, "decontamination")


def _pass(frame, text, sent, ranges, found, verdict, carried, kept, last, one_in):
    where, names = frame.columns.index(text), list(frame.columns)
    span = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    more = [T.StructField(verdict, T.StructType(RESULT))] if last else [T.StructField(ranges, span), T.StructField(found, T.ArrayType(T.StringType()))]
    schema = T.StructType([frame.schema[c] for c in kept] + more)
    at = [names.index(c) for c in kept]
    out_names = schema.fieldNames()
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
    span_kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        index = sent.value
        for batch in batches:
            for part in slices(batch, where):
                hits = index.hits(encoded(part.column(where)))
                if carried:
                    before, ids = part.column(names.index(ranges)).to_pylist(), part.column(names.index(found)).to_pylist()
                    hits = [(n, r + [(x["a"], x["b"]) for x in q], s | set(t)) for (n, r, s), q, t in zip(hits, before, ids)]
                merged = [(n, covered(r), sorted(s)) for n, r, s in hits]
                if last:
                    rows = []
                    for n, r, s in merged:
                        hit = sum(b - a for a, b in r)
                        digest = hashlib.sha256(",".join(s).encode()).hexdigest()
                        rows.append({"n_words": n, "n_hit": hit, "n_items": len(s), "items_sha256": digest, "contaminated": hit > 0 and one_in * hit >= n})
                    extra = [pa.array(rows, kind)]
                else:
                    extra = [pa.array([[{"a": a, "b": b} for a, b in r] for _, r, _ in merged], span_kind), pa.array([s for _, _, s in merged], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in at] + extra, out_names)

    return frame.mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    column = verdict_column(docs)
    return find_contamination(docs, benchmark, **options).where(~F.col(column)["contaminated"]).drop(column)
