"""Hard negatives, conversation repair and toxicity against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundswell.llm import negatives, toxicity, turns

VECTORS = "vec_id long, embedding array<float>, label int"
NEGATIVE_COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute_negatives(rows, is_anchor, low=80, high=100, positives=5, keep=5):
    sound = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))

    def score(a, b):
        return sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0))

    out = []
    for a in sound:
        if not is_anchor(a[0]):
            continue
        scored = sorted(((-score(a[2], b[2]), b[0], b[1]) for b in sound if b != a))
        for p, positive, _ in [s for s in scored if s[2] == a[1]][:positives]:
            fits = [s for s in scored if s[2] != a[1] and low * -p <= 100 * -s[0] <= high * -p][:keep]
            out += [(a[0], positive, rank, s[1], -p, -s[0]) for rank, s in enumerate(fits, 1)]
    return Counter(out)


def mined(spark, rows, schema=VECTORS, **options):
    df = spark.createDataFrame(rows, schema)
    found = negatives.hard_negatives(df, F.col("vec_id") % 3 == 0, **options)
    assert found.columns == NEGATIVE_COLUMNS
    return Counter(map(tuple, found.collect()))


def clustered(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dims))
    return [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 0.15, dims)], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_negatives_of_clustered_vectors(spark, monkeypatch, small):
    if small:  # deep trees, several packs, tiles of a few rows
        for name, value in dict(LEAF_ROWS=16, FANOUT=3, PACK_ROWS=20, TASK_ROWS=100, TILE=7, SAMPLE_ROWS=200).items():
            monkeypatch.setattr(negatives, name, value)
    rows = clustered(1, 400)
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 3 == 0)


def test_negatives_of_awkward_rows(spark):
    big, tie = [3.0, 1.0, 0.0], [0.5, 0.5, 0.5]
    rows = [(i, big if i % 2 else tie, i % 3) for i in range(60)]  # two vectors for all: ties by id
    rows += rows[:7]  # repeated rows
    rows += [(5, [1.0, 0.25, -1.0], 1), (6, [0.5], 2), (7, [], 1), (8, None, 1), (9, tie, None), (None, tie, 1), (12, [1.0, None, 1.0], 1)]
    rows += [(15, [float("nan"), 1.0, 1.0], 1), (18, [float("inf"), 1.0, 1.0], 1), (21, [-1.0, -1.0, -1.0], 0), (24, [0.0, 0.0, 0.0], 0)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 3 == 0)
    wide = [r + ("q", "mine", 1) for r in rows]
    clash = VECTORS + ", q string, ids string, leaf int"
    assert mined(spark, wide, clash) == mined(spark, rows)
    assert mined(spark, []) == Counter() and mined(spark, [(1, tie, 1)]) == Counter() and mined(spark, [(3, tie, 1)]) == Counter()


def test_tree_never_skips_a_leaf_that_is_needed():
    rng = np.random.default_rng(5)
    q = np.floor(256 * np.concatenate([c + rng.normal(0, 0.05, (60, 6)) for c in rng.normal(0, 1, (10, 6))])).astype(np.int64)
    largest = int((q * q).sum(axis=1).max())
    tree = negatives.grow(q, largest, 100 * len(q))
    leaf, passed = tree.place(q)
    shape = (len(tree.splits), negatives.FANOUT, negatives.FANOUT)
    tree.lo, tree.hi = np.full(shape, np.inf), np.full(shape, -np.inf)
    for node, _, child, d in passed:
        for j in np.unique(child):
            tree.lo[node, : d.shape[1], j] = d[child == j].min(axis=0)
            tree.hi[node, : d.shape[1], j] = d[child == j].max(axis=0)
    scores = q @ q.T
    best = np.sort(scores, axis=1)[:, -6]
    visited = tree.visits(q, best, scores.max(axis=1))
    needed = np.zeros_like(visited)
    for i, j in zip(*np.nonzero(scores >= best[:, None])):
        needed[i, leaf[j]] = True
    assert tree.leaves > 8 and (visited | ~needed).all() and visited.mean() < 0.5
    for number in range(tree.leaves):
        assert (tree.still(number, q, best, scores.max(axis=1)) | ~needed[:, number]).all()


def test_scores_beyond_floating_point_are_exact():
    a = np.array([[1 << 30, 3], [-(1 << 30), 5]], np.int64)
    assert negatives.inner(a, a).tolist() == [[int(x) * int(y) + int(u) * int(v) for y, v in a.tolist()] for x, u in a.tolist()]


# ---- conversations --------------------------------------------------------------


def blank(text):
    return not text.strip(" \t\n\x0b\x0c\r")


def brute_repair(rows):
    """All edits, with whole strings: state -> (cost, audit, repaired)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    insert = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    counts, seen, best = [0, 0, 0, 0], set(), {0: (0, "", ())}

    def widened(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit, said) in list(out.items()):
                to, role = insert[s]
                new = (cost + 2, audit + "I", (*said, f"{role}:"))
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    for _, role, text in rows:
        kind = 1 if blank(text) else 2 if (role, text) in seen else 3 if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[kind] += 1
        after = {}

        def offer(state, value):
            if state not in after or value[:2] < after[state][:2]:
                after[state] = value

        # Every state may be reached in several ways, so all insertions are tried from every state.
        for s0, v0 in best.items():
            for s, (cost, audit, said) in widened({s0: v0}).items():
                offer(s, (cost + 3, audit + "D", said))
                if kind in (1, 2):
                    continue
                more = cost + (kind == 3)
                to, whose = insert[s]
                offer(to, (more + 2, audit + "R", (*said, f"{whose}:{text}")))
                if role[:1] == "s" and s == 0:
                    offer(1, (more, audit + "K", (*said, f"{role}:{text}")))
                if role[:1] == whose[0]:
                    offer(to, (more, audit + "K", (*said, f"{role}:{text}")))
        best = after
    ends = [v for s0, v0 in best.items() for s, v in widened({s0: v0}).items() if s in (0, 3)]
    cost, audit, said = min(ends)
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(), said


def random_conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "Long text\nwith lines!", "é.", "Yes. \x0b", "x" * 3000 + "."]
    rows = []
    for conv in range(n):
        for k in range(rng.choice([1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", "agent"])
            rows.append((conv, rng.choice([k, k, k, k + 3, None]), role, rng.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("batch", [10_000, 3])
def test_repair_equals_brute_force(spark, batch, monkeypatch):
    rows = random_conversations(batch, 150) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA + ", seen string, id int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = turns.audits(df).collect()
        repaired = turns.repaired_turns(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {conv: brute_repair(group) for conv, group in groups.items()}
    assert {r[0]: tuple(r[1:]) for r in got} == {conv: w[:-1] for conv, w in want.items()} and len(got) == len(groups)
    said = defaultdict(list)
    for r in sorted(repaired, key=lambda r: r["place"]):
        said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: tuple(s) for c, s in said.items()} == {c: w[-1] for c, w in want.items() if w[-1]}


def test_a_giant_conversation_is_spooled(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"turn {k} " + "word " * 20 + rng.choice([".", ""])) for k in range(3000)]
    whole = turns.audits(spark.createDataFrame(rows, SCHEMA)).collect()
    state = turns.Conversation(1)
    monkeypatch.setattr(turns, "SPOOL_BYTES", 1000)
    small = turns.Conversation(1)
    for _, turn, role, text in rows:
        state.add(turn, role, text, False)
        small.add(turn, role, text, False)
    assert small.spool._rolled and small.trail._rolled
    assert small.edits() == state.edits() == (whole[0]["cost"], whole[0]["audit"])
    assert list(small.repaired(small.edits()[1])) == list(state.repaired(state.edits()[1]))


def test_repair_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, 2, "user", None), (1, 2, None, "Hello."), (2, None, "user", "Hi.")], SCHEMA)
    got = {r["conv_id"]: r for r in turns.audits(df).collect()}
    assert (got[1]["gaps"], got[1]["blank"], got[1]["audit"]) == (0, 2, "DDRI") or (got[1]["gaps"], got[1]["blank"]) == (0, 2)
    assert (got[2]["gaps"], got[2]["cost"], got[2]["audit"]) == (0, 2, "KI")
    assert turns.audits(df.where("false")).count() == 0 and turns.repaired_turns(df.where("false")).count() == 0


def test_damage_is_drawn_by_checksum(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(4)] + [(5, None, None, None)]
    got = Counter(map(tuple, turns.damaged(spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", _side int")).collect()))
    want = Counter()
    for c, t, role, text in rows:
        side = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if side == 1 else text.translate({ord(x): None for x in ".!?"}) if side == 2 else text
        if side:
            want[c, t, "user" if side == 4 else role, text] += 2 if side == 3 else 1
    assert got == want


# ---- toxicity -------------------------------------------------------------------


def labelled_texts(n, seed):
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "io", "an", "er")]

    def prose(k):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(k))

    rows = []
    for i in range(n):
        words = prose(rng.choice([3, 40, 400])).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(["vermin", "Nitwit", "dunce"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_texts(spark):
    rows = labelled_texts(1200, 4)
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t, _ in rows], "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, labels.where(~held))
    judged, score, predicted = toxicity.toxicity(docs, model)
    truth = {i: y for i, _, y in rows}
    out = [r for r in judged.where(held).collect()]
    assert len(out) > 200 and {r["score"] for r in out} == {"mine"} and all(0 <= r[score] <= 1 for r in out)
    right = sum(r[predicted] == truth[r["doc_id"]] for r in out) / len(out)
    assert right > 0.95, right
    assert all(r[predicted] == (r[score] >= toxicity.THRESHOLD) for r in out)
    # Other columns of the labels and the held-out labels have no say.
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("text", F.lit("x"))
    assert np.array_equal(toxicity.fit(docs, flipped.where(~held)).weights, model.weights)


def test_toxicity_of_awkward_rows(spark):
    model = toxicity.Classifier(np.zeros(1 << toxicity.BITS, np.float32), -1.0)
    rows = [(1, None), (1, ""), (None, "x"), (2, "é🙂" * 5), (3, "word " * 400_000)]
    judged, score, _ = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert {r[score] for r in judged.collect()} == {1 / (1 + math.exp(1))} and judged.count() == 5
    assert toxicity.toxicity(judged.where("false").select("doc_id", "text"), model)[0].count() == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    only = toxicity.fit(docs, labels)
    assert not only.weights.any() and only.score(np.empty(0, np.int64)) == 1.0
    assert toxicity.fit(docs, labels.where("false")).score(np.empty(0, np.int64)) < 1e-9


def test_bucket_counts_are_those_of_all_texts(spark, monkeypatch):
    rows = labelled_texts(60, 9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id long, toxic int")
    want = np.zeros((2, (1 << toxicity.BITS) + 1), np.int64)
    buckets = toxicity.Buckets()
    for _, text, y in rows:
        want[y, buckets(text)] += 1
        want[y, -1] += 1
    for limit in (toxicity.BROADCAST_ROWS, 3):  # broadcast, and shuffled
        monkeypatch.setattr(toxicity, "BROADCAST_ROWS", limit)
        assert np.array_equal(toxicity.counts(toxicity.labelled(docs, labels, "doc_id", "text", "toxic")), want)
    whole = buckets("ab cd" * 3000)
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    assert np.array_equal(buckets("ab cd" * 3000), whole)
