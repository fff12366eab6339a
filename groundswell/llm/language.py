"""Language identification with a byte convolutional network, trained and applied in numpy.

Bytes fall into classes (letters, other ASCII, UTF-8 lead and continuation bytes); a filter
of width w adds up w learned numbers, one for the class at each of its places.
Filters of several widths run over windows of WINDOW bytes, the maximum over the
window is taken, and a softmax layer gives the languages.  Training is Adam on the
cross-entropy of windows from a bounded sample of labelled texts (TRAIN_ROWS rows, as
many of each language, however many languages there are, a stretch of SAMPLE_CHARS characters at a place given by a
hash).  A text is judged by the mean log-odds of all of its windows.

The sample and the weights are all that passes through the driver, both of fixed size.
Texts are read in slices and cut into windows, so a long text needs no more memory than
its windows' classes.  Null texts and texts without a letter are `und`; without labelled
rows every text is.  Repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundswell.llm.frames import annotate, fresh

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
TRAIN_ROWS, SAMPLE_CHARS, EPOCHS, BATCH, LEARNING_RATE = 6_000, 400, 8, 64, 0.02
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _byte_classes() -> np.ndarray:
    """0 pads; letters; space, digit, other ASCII; each continuation and lead byte for itself."""
    out = np.zeros(256, np.int16)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            out[b] = 30 + b - 0x80
        elif c.isalpha():
            out[b] = 1 + ord(c.lower()) - ord("a")
        else:
            out[b] = 27 if c.isspace() else 28 if c.isdigit() else 29
    return out


CLASSES = _byte_classes()
N_CLASSES = int(CLASSES.max()) + 1


@dataclass(frozen=True)
class Network:
    """`tables[w][k, class, filter]` for place k of width w; `dense[feature, language]`."""

    languages: tuple[str, ...]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> dict[int, list[tuple[int, np.ndarray, bool]]]:
        """Per width, `(offset, table, over byte pairs)`: two neighbouring places are one look-up."""
        out = {}
        for w, t in self.tables.items():
            steps = []
            for k in range(0, w - 1, 2):
                steps.append((k, (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(-1, t.shape[2]), True))
            if w % 2:
                steps.append((w - 1, np.ascontiguousarray(t[w - 1]), False))
            out[w] = steps
        return out


def windows(text: bytes) -> np.ndarray:
    """Byte classes of the text in rows of WINDOW, the last one padded."""
    classes = CLASSES[np.frombuffer(text, np.uint8)]
    rows = max(1, -(-len(classes) // WINDOW))
    out = np.zeros(rows * WINDOW, np.int16)
    out[: len(classes)] = classes
    return out.reshape(rows, WINDOW)


def log_odds(net: Network, pairs, rows: np.ndarray) -> np.ndarray:
    """One row of log-odds per window."""
    rows = rows.astype(np.int32)
    joined = rows[:, :-1] * N_CLASSES + rows[:, 1:]
    features = []
    for w, steps in pairs.items():
        n = WINDOW - w + 1
        total = None
        for offset, table, double in steps:
            source = joined if double else rows
            part = table.take(source[:, offset : offset + n], axis=0)
            total = part if total is None else np.add(total, part, out=total)
        features.append(total.max(axis=1))
    hidden = np.maximum(np.concatenate(features, axis=1) + net.bias, 0)
    return hidden @ net.dense + net.out_bias


def train(rows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], seed: int = 7) -> Network:
    """Adam on the cross-entropy of single windows."""
    rng = np.random.default_rng(seed)
    n_features = len(WIDTHS) * FILTERS
    tables = {w: rng.normal(0, 0.3, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
    params = [tables[w] for w in WIDTHS]
    bias = np.zeros(n_features, np.float32)
    dense = rng.normal(0, 0.2, (n_features, len(languages))).astype(np.float32)
    out_bias = np.zeros(len(languages), np.float32)
    params += [bias, dense, out_bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    filters = np.arange(FILTERS)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, y = rows[pick].astype(np.int32), labels[pick]
            b = np.arange(len(x))
            pooled, places = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                response = sum(tables[w][k].take(x[:, k : k + n], axis=0) for k in range(w))
                place = response.argmax(axis=1)
                places.append(place)
                pooled.append(np.take_along_axis(response, place[:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + bias
            hidden = np.maximum(raw, 0)
            z = hidden @ dense + out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[b, y] -= 1
            z /= len(x)
            back = (z @ dense.T) * (raw > 0)
            gradients = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(tables[w])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    classes = np.take_along_axis(x, places[i] + k, axis=1)
                    np.add.at(g[k], (classes, np.broadcast_to(filters, classes.shape)), part)
                gradients.append(g)
            gradients += [back.sum(axis=0), hidden.T @ z, z.sum(axis=0)]
            step += 1
            rate = LEARNING_RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(params, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return Network(languages, tables, bias, dense, out_bias)


def sample(labelled: DataFrame, id: str, text: str, label: str, train_rows: int = TRAIN_ROWS) -> list:
    """At most `train_rows` stretches `(text, label)`, the same share for each label, but at least one row of each.

    A label's rows are those with the least hash of id and text, so no label can crowd out another.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(label).alias("label"))
    labels = rows.agg(F.count_distinct("label").alias("n")).first()["n"]
    if not labels:
        return []
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    drawn = rows.select("label", F.substring("text", place, F.lit(SAMPLE_CHARS)).alias("text"), F.xxhash64("id", "text").alias("draw"))
    # Spark keeps the first rows of each label before it shuffles, so a frequent label is no hot key.
    order = F.row_number().over(Window.partitionBy("label").orderBy("draw", "text"))
    picked = drawn.withColumn("place", order).where(F.col("place") <= max(1, train_rows // labels))
    return picked.orderBy("draw", "label", "text").select("label", "text").collect()


def fit(labelled: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", train_rows: int = TRAIN_ROWS) -> Network | None:
    picked = sample(labelled, id, text, label, train_rows)
    if not picked:
        return None
    languages = tuple(sorted({r["label"] for r in picked}))
    rows, labels = [], []
    for r in picked:
        part = windows(r["text"].encode())
        rows.append(part[:1] if len(part) == 1 else part[:-1])
        labels += [languages.index(r["label"])] * len(rows[-1])
    return train(np.concatenate(rows), np.array(labels), languages)


def identify(docs: DataFrame, net: Network | None, text: str = "text", keep=None) -> tuple[DataFrame, str, str]:
    """`keep` (default: all columns) and two columns, whose names are returned: language and its probability."""
    language, score = fresh(docs, "lang_pred"), fresh(docs, "score")

    def make():
        pairs = net.pairs() if net else None

        def judge(texts: list[str | None]) -> list[tuple[str, float]]:
            out = [(UNKNOWN, 0.0)] * len(texts)
            known = [i for i, t in enumerate(texts) if net and t is not None and _LETTER.search(t)]
            if not known:
                return out
            parts = [windows(texts[i].encode()) for i in known]
            stacked = np.concatenate(parts)
            odds = np.concatenate([log_odds(net, pairs, stacked[i : i + 256]) for i in range(0, len(stacked), 256)])
            filled = (stacked != 0).sum(axis=1).astype(np.float64)
            at = np.cumsum([0] + [len(p) for p in parts])[:-1]
            mean = np.add.reduceat(odds * filled[:, None], at, axis=0) / np.maximum(np.add.reduceat(filled, at), 1)[:, None]
            share = np.exp(mean - mean.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            for i, row in zip(known, share):
                best = int(row.argmax())
                out[i] = (net.languages[best], float(row[best]))
            return out

        def work(texts):
            found = judge(texts.to_pylist())
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return work

    fields = [T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())]
    return annotate(docs, text, fields, make, keep), language, score


def fold(id: Column) -> Column:
    """0 .. 4; fold 0 is held out of training. A null id is in fold 0."""
    return F.coalesce(F.crc32(id.cast("string")) % 5, F.lit(0))
