"""Running a stream to the end of what is there, into tables in the shared folder."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundswell.plans.shared import fresh_path
from groundswell.sources.folder import Folder


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append mode into files, with the file sink's exactly-once commit log."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_epochs(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """`foreachBatch`; `write` gets the epoch and must replace what that epoch wrote before."""
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def epoch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Each epoch owns one folder, so a repeated epoch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def merging_writer(path: str, keys: list[str], least_rows: int = 100_000) -> Callable[[DataFrame, int], None]:
    """`epoch_writer` for updates of keyed rows, with a merge now and then, so that readers need not see every epoch.

    When the epochs since the last merge hold as many rows as its result (and `least_rows`), the newest row of each key is
    written to a folder of its own and a manifest names it: the result doubles or the epochs have turned over all of it, so a row
    is rewritten about as often as the number of keys doubles, and a reader's cost follows the keys, not the epochs.
    """
    write_epoch = epoch_writer(path)

    def write(batch: DataFrame, epoch: int) -> None:
        write_epoch(batch, epoch)
        spark = batch.sparkSession
        base = _base(spark, path, below=epoch)
        waiting = read_epochs(spark, path, batch.schema).where(F.col("epoch").between(base["epoch"] + 1, epoch))
        if waiting.count() < max(least_rows, base["rows"]):  # counted from the files' footers
            return
        merged = newest(_from_base(spark, path, batch.schema, base, upto=epoch), keys)
        merged.write.mode("overwrite").parquet(f"{path}/_merged/upto={epoch}")
        rows = spark.read.parquet(f"{path}/_merged/upto={epoch}").count()
        Folder(spark, f"{path}/_merges").create(f"merge-{epoch:012d}", json.dumps({"epoch": epoch, "rows": rows}))

    return write


def _base(spark: SparkSession, path: str, below: int | None = None) -> dict:
    """The last merge; that of a repeated epoch, or of one behind it, does not count."""
    folder = Folder(spark, f"{path}/_merges")
    names = [n for n in folder.names("merge-") if below is None or int(n.removeprefix("merge-")) < below]
    return json.loads(folder.read(names[-1], last="}")) if names else {"epoch": -1, "rows": 0}


def _from_base(spark: SparkSession, path: str, schema: StructType, base: dict, upto: int | None = None) -> DataFrame:
    later = read_epochs(spark, path, schema).where(F.col("epoch") > base["epoch"])
    later = later if upto is None else later.where(F.col("epoch") <= upto)
    if base["epoch"] < 0:
        return later
    merged = spark.read.schema(schema).parquet(f"{path}/_merged/upto={base['epoch']}")
    return merged.withColumn("epoch", F.lit(base["epoch"]).cast("long")).unionByName(later)


def read_merged(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The last update of each key, from the last merge and the epochs after it; other epochs are pruned."""
    return newest(_from_base(spark, path, schema, _base(spark, path)), keys)


def read_epochs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add("epoch", "long")).parquet(path)


def newest(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in epochs.columns if c not in (*keys, "epoch")]
    return epochs.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("s")).select(*keys, "s.*")


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh output path and checkpoint location."""
    base = fresh_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
