"""SentencePiece encoding and decoding of whole texts.

`pieces.Encoder` is the max-plus machine over characters.  Texts up to `chunk_chars`
are encoded where they are read.  A longer text is cut into chunks, which are dealt
over the cluster and written to the shared folder: (1) every chunk yields its matrix
between the states at its two cuts, (2) a text's matrices are combined in a tree,
which fixes the state at every cut, (3) every chunk is backtraced on its own between
its two states, (4) the ids are put together by text.  Only matrices, states and ids meet
per text, and only texts over the limit are shuffled, by (text, chunk).

Null texts get null ids, empty ones none.  Repeated rows are encoded each.  Extra
columns are passed through.  Decoding undoes encoding exactly, for every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundswell.llm.frames import annotate, fresh
from groundswell.llm.pieces import MARK, Decoder, Encoder, Vocabulary, states
from groundswell.plans.shared import materialize, parallelism, ship_package

CHUNK_CHARS = 32_768
CHUNKS_AT_ONCE = 16  # rows that a worker unpacks together
IDS = T.ArrayType(T.IntegerType())
_machines: dict[tuple, Encoder | Decoder] = {}


def _machine(kind, sent):
    """One encoder or decoder per worker process and vocabulary, so that its memory of units lives on."""
    v = sent.value
    key = (kind, v.kind, len(v.pieces), hash(v.pieces), hash(v.scores))
    if key not in _machines:
        _machines[key] = kind(v)
    return _machines[key]


def _send(docs: DataFrame, vocabulary: Vocabulary):
    ship_package(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded: a model file's pieces


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", keep=None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """`keep` (default: all columns) and the array column `ids` (renamed if taken, see `fresh`)."""
    ids = fresh(docs, ids)
    kept = list(docs.columns if keep is None else keep)
    sent = _send(docs, vocabulary)
    chunk_chars = max(chunk_chars, *map(len, vocabulary.pieces))  # a piece spans two chunks at most
    long = F.length(text) > chunk_chars

    def make():
        encoder = _machine(Encoder, sent)

        def work(texts):
            rows = texts.to_pylist()
            done = encoder.encode_all([t or "" for t in rows])
            ends = np.cumsum([0] + [len(d) for d in done]).astype(np.int32)
            nulls = pa.array([t is None for t in rows])
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(done)), mask=nulls)]

        return work

    short = annotate(docs.where(~F.coalesce(long, F.lit(False))), text, [T.StructField(ids, IDS)], make, kept)
    return short.unionByName(_encode_long(docs.where(long), sent, text, ids, kept, chunk_chars))


def _chunks(long: DataFrame, text: str, key: str, longest: int, chunk_chars: int) -> DataFrame:
    """`(key, no, count, left, body, right)`: chunks with their margins."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    around = F.transform(
        F.col("_pieces"),
        lambda p, i: F.struct(
            i.alias("no"),
            F.coalesce(F.right(F.get(F.col("_pieces"), i - 1), F.lit(longest)), F.lit("")).alias("left"),
            p.alias("body"),
            F.coalesce(F.left(F.get(F.col("_pieces"), i + 1), F.lit(longest)), F.lit("")).alias("right"),
        ),
    )
    return (
        long.select(key, pieces.alias("_pieces"))
        .select(key, F.size("_pieces").alias("count"), F.explode(around).alias("c"))
        .select(key, "count", "c.*")
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNKS_AT_ONCE):
            yield batch.slice(i, CHUNKS_AT_ONCE)


def _window(encoder: Encoder, no: int, left: str, body: str, right: str) -> tuple[str, int, int]:
    """Marked text of a chunk with margins, and the chunk's bounds in it."""
    start = len(left) + (1 if no == 1 else 0)
    if no == 0:
        marked = MARK + encoder.marked(body + right)
        return marked, 0, 1 + len(body)
    marked = encoder.marked(left + body + right)
    if no == 1:  # the margin may reach the text's beginning, where the mark stands
        marked = MARK + marked
    return marked, start, start + len(body)


_STATE = T.StructType([T.StructField("over", T.IntegerType()), T.StructField("piece", T.LongType())])
_STATE_ARROW = pa.struct([("over", pa.int32()), ("piece", pa.int64())])


def _state(s) -> dict | None:
    return None if s is None else {"over": s[0], "piece": s[1]}


def _pair(s) -> tuple[int, int] | None:
    return None if s is None else (s["over"], s["piece"])


def _encode_long(long: DataFrame, sent, text: str, ids: str, kept: list[str], chunk_chars: int) -> DataFrame:
    spark = long.sparkSession
    longest = max(map(len, sent.value.pieces))
    key = fresh(long, "_row")
    # The key is written before it is used, so a task that runs again cannot give other keys.
    rows = materialize(long.select(*dict.fromkeys([*kept, text]), F.monotonically_increasing_id().alias(key)), "long-texts")
    chunks = _chunks(rows, text, key, longest, chunk_chars).repartition(parallelism(spark), key, "no")
    chunks = materialize(chunks, "chunks")
    cells = T.ArrayType(T.StructType([T.StructField("a", _STATE), T.StructField("b", _STATE), T.StructField("w", T.DoubleType())]))
    cells_arrow = pa.list_(pa.struct([("a", _STATE_ARROW), ("b", _STATE_ARROW), ("w", pa.float64())]))

    def matrices(batches):
        encoder = _machine(Encoder, sent)
        for part in _parts(batches):
            out = []
            for r in part.to_pylist():
                marked, start, end = _window(encoder, r["no"], r["left"], r["body"], r["right"])
                found = encoder.transfer(marked, start, end, r["no"] == 0)
                out.append([{"a": _state(a), "b": _state(b), "w": w} for (a, b), w in found.items()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, cells_arrow)], [key, "no", "cells"])

    def resolve(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        chain = [{(_pair(c["a"]), _pair(c["b"])): c["w"] for c in m} for m in table.column("cells").to_pylist()]
        at = states(chain)
        return pa.table(
            {
                key: table.column(key),
                "no": table.column("no"),
                "entry": pa.array([_state(s) for s in at[:-1]], _STATE_ARROW),
                "exit": pa.array([_state(s) for s in at[1:]], _STATE_ARROW),
            }
        )

    transfers = chunks.select(key, "no", "left", "body", "right").mapInArrow(matrices, T.StructType([chunks.schema[key], chunks.schema["no"], T.StructField("cells", cells)]))
    fixed = transfers.groupBy(key).applyInArrow(
        resolve, T.StructType([chunks.schema[key], chunks.schema["no"], T.StructField("entry", _STATE), T.StructField("exit", _STATE)])
    )

    def backtraces(batches):
        encoder = _machine(Encoder, sent)
        for part in _parts(batches):
            out = []
            for r in part.to_pylist():
                marked, start, end = _window(encoder, r["no"], r["left"], r["body"], r["right"])
                out.append(encoder.chunk_ids(marked, start, end, _pair(r["entry"]), _pair(r["exit"])))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.int32()))], [key, "no", "part"])

    with_states = chunks.join(fixed, [key, "no"]).select(key, "no", "left", "body", "right", "entry", "exit")
    parts = with_states.mapInArrow(backtraces, T.StructType([chunks.schema[key], chunks.schema["no"], T.StructField("part", IDS)]))
    whole = parts.groupBy(key).agg(F.flatten(F.sort_array(F.collect_list(F.struct("no", "part")))["part"]).alias(ids))
    return rows.join(whole, key).select(*kept, ids)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded", keep=None) -> DataFrame:
    """`keep` (default: all columns) and the text that the ids spell; null ids give null."""
    text = fresh(rows, text)
    kept = list(rows.columns if keep is None else keep)
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(text, T.StringType())])
    names, at, where = schema.fieldNames(), [rows.columns.index(c) for c in kept], rows.columns.index(ids)
    sent = _send(rows, vocabulary)

    def run(batches):
        decoder = _machine(Decoder, sent)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(part.column(where)), 0).to_numpy(zero_copy_only=False))
                decoded = decoder.decode(pc.list_flatten(part.column(where)).to_numpy(), ends)
                texts = [t.decode() if valid else None for t, valid in zip(decoded, part.column(where).is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(j) for j in at] + [pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, schema)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the comma-joined ids."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
