"""The rows of one key in the order of arrival, however many a trigger brings.

Rows are sorted in runs of RUN_ROWS; a key with more of them has its runs in an unnamed scratch file of the running task and merges them
block by block, FAN_IN at a time, so a task's memory does not grow with the trigger.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

RUN_ROWS = 50_000
BLOCK_ROWS = 2048
FAN_IN = 64
_TYPES = {"string": pa.string(), "long": pa.int64()}
_LAST = np.iinfo(np.int64).max  # where a null is sorted


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def by_arrival(frames: Iterable[pd.DataFrame], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of all rows, ordered by `seq`; rows with the same `seq` stay in the order they come in."""
    held: list[pa.RecordBatch] = []
    scratch = None
    for frame in frames:
        if sum(b.num_rows for b in held) >= RUN_ROWS:
            scratch = scratch or _Scratch(schema)
            scratch.add(_blocks(held))
            held = []
        held.append(pa.RecordBatch.from_pandas(frame, schema, preserve_index=False, nthreads=1))
    last = _blocks(held) if held else iter(())
    yield from scratch.merged(last) if scratch else last


def values(block: pa.RecordBatch, names: Iterable[str]) -> Iterator[tuple]:
    """Rows of plain values; `to_pylist` takes a microsecond for each of them."""
    columns = [block.column(name) for name in names]
    plain = [c.to_pylist() if c.null_count and c.type == pa.int64() else c.to_numpy(zero_copy_only=False).tolist() for c in columns]
    return zip(*plain, strict=True)


def _keys(block: pa.RecordBatch) -> np.ndarray:
    return block.column("seq").fill_null(_LAST).to_numpy()


def _sorted(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
    return whole.take(pa.array(np.argsort(_keys(whole), kind="stable")))


def _blocks(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = _sorted(parts)
    for at in range(0, whole.num_rows, BLOCK_ROWS):
        yield whole.slice(at, BLOCK_ROWS)


def _merge(runs: list[Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Of rows with the same `seq`, those of an earlier run come first."""
    heads = {i: (block, _keys(block)) for i, run in enumerate(runs) if (block := next(run, None)) is not None}
    while heads:
        # The block that ends first: whatever precedes its end is in memory.
        end, first = min((keys[-1], i) for i, (_, keys) in heads.items())
        parts = []
        for i, (block, keys) in list(heads.items()):
            n = int(np.searchsorted(keys, end, side="right" if i <= first else "left"))
            if n:
                parts.append(block.slice(0, n))
            if n < len(keys):
                heads[i] = (block.slice(n), keys[n:])
            elif (block := next(runs[i], None)) is not None:
                heads[i] = (block, _keys(block))
            else:
                del heads[i]
        yield _sorted(parts)


class _Scratch:
    """Sorted runs in one file, as places of their blocks; a level that holds FAN_IN runs becomes one run of the next."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.file = tempfile.TemporaryFile()
        self.levels: list[list[list[tuple[int, int, int]]]] = []

    def add(self, blocks: Iterator[pa.RecordBatch], level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        runs = self.levels[level]
        runs.append([self._write(b) for b in blocks])
        if len(runs) == FAN_IN:
            self.add(_merge([self._read(r) for r in runs]), level + 1)
            runs.clear()

    def merged(self, last: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with self.file:
            yield from _merge([self._read(r) for level in reversed(self.levels) for r in level] + [last])

    def _write(self, block: pa.RecordBatch) -> tuple[int, int, int]:
        raw = block.serialize()
        packed = pa.compress(raw, codec="lz4", asbytes=True)
        at = self.file.seek(0, 2)
        self.file.write(packed)
        return at, len(packed), raw.size

    def _read(self, run: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        for at, size, raw in run:
            self.file.seek(at)
            yield pa.ipc.read_record_batch(pa.decompress(self.file.read(size), raw, codec="lz4"), self.schema)
