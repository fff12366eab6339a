"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct runs of SIZES characters of its lower-cased
form (with a space on both ends), hashed into 2**BITS buckets.  For every bucket the texts of both labels that hold
it are counted over all labelled rows, whole texts; the feature's value is the log of the ratio of the two
smoothed shares, divided by the square root of the text's number of features, so that long texts are
not judged by their length.  A logistic regression over these values (AdaGrad, in numpy) is fitted on a
bounded sample in about STEPS steps: at most TRAIN_ROWS rows, half of each label if there are as many, a stretch of SAMPLE_CHARS
characters of each at a place drawn by a hash; rows are weighted so that the labels keep their true shares.

The counts (2**BITS rows) and the sample pass through the driver; both sizes are fixed.  Labels are joined by
broadcast only if they are at most BROADCAST_ROWS rows, else both sides are shuffled by id.

A null text counts as empty; an empty text has no features and gets the score of the bias.  Long texts are read in pieces of
PIECE characters.  Rows without an id, labels that are null and labels without a text are never learned from;
a repeated row of the labels counts once, a repeated document is judged (and learned) as often as it occurs.  Unless both labels
occur among the rows to learn from, every score is the share of label 1 (0 without any row).
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundswell.llm.frames import annotate, fresh
from groundswell.plans.shared import ship_package

BITS, SIZES, PIECE = 18, (3, 4, 5), 1 << 20
TRAIN_ROWS, SAMPLE_CHARS, STEPS, BATCH, RATE, SHRINK = 4_000, 4_000, 1_000, 32, 0.1, 1e-4
BROADCAST_ROWS = 1_000_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Classifier:
    """`weights[bucket]` already holds the learned weight times the log-count ratio."""

    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        z = self.bias + float(self.weights[buckets].sum(dtype=np.float64)) / max(1.0, len(buckets) ** 0.5)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


class Buckets:
    """The distinct buckets of a text; one scratch table serves all texts of a task."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        chars = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        if not text:
            return np.empty(0, np.int64)
        widest = max(SIZES)
        for at in range(0, len(chars), PIECE):
            self._mark(chars[at : at + PIECE + widest - 1])
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found

    def _mark(self, chars: np.ndarray) -> None:
        h = chars
        for n in range(2, max(SIZES) + 1):
            if len(chars) < n:
                return
            h = h[: len(chars) - n + 1] * np.uint32(0x9E3779B1) + chars[n - 1 :]
            h = h ^ (h >> np.uint32(15))
            if n in SIZES:
                self.seen[(h * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)) >> np.uint32(32 - BITS)] = True


def labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """`(id, text, toxic)` of the documents that have a label."""
    marks = _marks(labels, id, label)
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.join(marks, "id")


def _marks(labels: DataFrame, id: str, label: str) -> DataFrame:
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    return known.select(F.col(id).alias("id"), (F.col(label) == 1).alias("toxic")).distinct()


def counts(rows: DataFrame) -> np.ndarray:
    """Texts of `rows` (`text, toxic`) that hold each bucket: row 0 without the label, row 1 with it; two totals at the end."""
    ship_package(rows.sparkSession)

    def run(batches):
        table, buckets = np.zeros((2, (1 << BITS) + 1), np.int64), Buckets()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[int(toxic), buckets(text)] += 1
                table[int(toxic), -1] += 1
        held = np.flatnonzero(table.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held), *(pa.array(side[held]) for side in table)], ["bucket", "clean", "toxic"])

    parts = rows.select("text", "toxic").mapInArrow(run, "bucket long, clean long, toxic long")
    found = parts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((2, (1 << BITS) + 1), np.int64)
    for side, name in enumerate(("clean", "toxic")):
        out[side, found.column("bucket").to_numpy()] = found.column(name).to_numpy()
    return out


def sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int) -> list:
    """At most `rows` stretches `(text, toxic)`, half of each label: those with the least hash of their id."""
    marks = _marks(labels, id, label).withColumn("draw", F.xxhash64("id"))
    halves = [marks.where(F.col("toxic") == side).orderBy("draw", "id").limit(rows // 2) for side in (False, True)]
    place = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    stretch = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.substring(text, place, F.lit(SAMPLE_CHARS)).alias("text"))
    picked = stretch.join(F.broadcast(halves[0].unionByName(halves[1])), "id")  # at most `rows` labels
    # An id may own many documents: the bound holds for what reaches the driver as well.
    return picked.orderBy("draw", "id", "toxic", "text").limit(2 * rows).select("text", "toxic").collect()


def regression(features: list[np.ndarray], ratio: np.ndarray, toxic: np.ndarray, weight: np.ndarray, start: float, seed: int = 7) -> Classifier:
    rng = np.random.default_rng(seed)
    w, squares = np.zeros(len(ratio)), np.full(len(ratio), 1e-8)
    bias, bias_squares = start, 1e-8
    for _ in range(-(-STEPS * BATCH // len(features))):
        order = rng.permutation(len(features))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            sizes = np.array([len(features[i]) for i in pick])
            row, bucket = np.repeat(np.arange(len(pick)), sizes), np.concatenate([features[i] for i in pick])
            value = ratio[bucket] / np.maximum(1.0, np.sqrt(sizes))[row]
            z = bias + np.bincount(row, w[bucket] * value, len(pick))
            wrong = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic[pick]) * weight[pick] / len(pick)
            gradient = np.bincount(bucket, wrong[row] * value, len(w)) + SHRINK * w
            squares += gradient * gradient
            w -= RATE * gradient / np.sqrt(squares)
            bias_squares += wrong.sum() ** 2
            bias -= RATE * wrong.sum() / bias_squares**0.5
    return Classifier((w * ratio).astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Classifier:
    """Learn from the documents whose id has a label; other columns are not looked at."""
    table = counts(labelled(docs, labels, id, text, label))
    clean, toxic = (int(n) for n in table[:, -1])
    ratio = np.log((table[1, :-1] + 1) / (toxic + 2)) - np.log((table[0, :-1] + 1) / (clean + 2))
    picked = sample(docs, labels, id, text, label, train_rows) if clean and toxic else []
    sides = np.array([r["toxic"] for r in picked], np.float64)
    if not 0 < sides.sum() < len(sides):
        share = toxic / max(1, clean + toxic)
        return Classifier(np.zeros(1 << BITS, np.float32), float(np.log(max(share, 1e-300) / max(1 - share, 1e-300))))
    buckets = Buckets()
    features = [buckets(r["text"]).astype(np.int32) for r in picked]
    kept = np.where(sides == 1, toxic / sides.sum(), clean / (len(sides) - sides.sum()))
    return regression(features, ratio, sides, kept / kept.mean(), float(np.log(toxic / clean)))


def toxicity(docs: DataFrame, model: Classifier, text: str = "text", keep=None, threshold: float = THRESHOLD) -> tuple[DataFrame, str, str]:
    """`keep` (default: all columns) and two columns, whose names are returned: the score and the prediction (1 from `threshold` on)."""
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")

    def make():
        buckets = Buckets()

        def work(texts):
            scores = [model.score(buckets(t)) for t in texts.to_pylist()]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]

        return work

    fields = [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]
    return annotate(docs, text, fields, make, keep), score, predicted


def held_out(id: Column) -> Column:
    """The quarter of the ids that is never learned from; a null id is not held out, but no label can name it."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))
