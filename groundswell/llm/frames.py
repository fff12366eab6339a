"""Row-wise work on whole texts in Arrow batches, and names that cannot clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from groundswell.plans.shared import ship_package

SLICE_BYTES = 2 << 20

Work = Callable[[pa.Array], Sequence[pa.Array]]


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about `limit` bytes of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def annotate(df: DataFrame, text: str, fields: Sequence[T.StructField], make: Callable[[], Work], keep: Sequence[str] | None = None) -> DataFrame:
    """`keep` (default: every column) of `df` and the `fields` that `make()` computes from the texts, slice by slice.

    One pass, no shuffle; a task holds one Arrow batch and the work on one slice of it.
    """
    ship_package(df.sparkSession)
    kept = list(df.columns if keep is None else keep)
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    names = schema.fieldNames()
    at = [df.columns.index(c) for c in kept]
    where = df.columns.index(text)

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, where):
                yield pa.RecordBatch.from_arrays([part.column(i) for i in at] + list(work(part.column(where))), names)

    return df.mapInArrow(run, schema)


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
