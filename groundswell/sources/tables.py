"""The telemetry table: day partitions, pruned scans, retention and compaction."""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundswell import schema as S
from groundswell.operators.ingest import accepted_samples, validate_samples
from groundswell.operators.timeseries import series_range, site_feed
from groundswell.sources.batches import claimed_rows
from groundswell.sources.folder import Folder
from groundswell.sources.ledger import Ledger

COLUMNS = [f.name for f in S.TELEMETRY.fields]


def write_telemetry(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append samples by day.  The rebalance splits a heavy day and joins up light ones."""
    days = df.select(*COLUMNS, F.to_date("ts").alias("ts_date"))
    days.hint("rebalance", "ts_date").write.mode(mode).partitionBy("ts_date").parquet(path)


def write_epoch(df: DataFrame, path: str, epoch: str) -> None:
    """Append samples by day in folders of their own, one per day and `epoch`; the same epoch again replaces them."""
    days = df.withColumns({"ts_date": F.to_date("ts"), "epoch": F.lit(epoch)}).hint("rebalance", "ts_date")
    own = days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    own.partitionBy("ts_date", "epoch").parquet(path)


def store_uploads(uploads: DataFrame, now, path: str) -> None:
    """Decode, validate and append under numbers of the table's ledger: `seq` is unique, and later calls have larger ones.

    Calls and `stream_ingest` may fill one table together.  A call that fails gives its numbers up; what it
    had written stays hidden from `read_telemetry`, as Spark only shows the files of finished jobs.
    """
    ledger = Ledger(uploads.sparkSession, path)
    rows, claim = claimed_rows(uploads, ledger, f"call-{uuid.uuid4().hex}")
    try:
        write_epoch(accepted_samples(rows, now), path, f"call-{claim.number}")
    except Exception:
        ledger.void(claim)
        raise
    ledger.commit(claim)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The table, whether `write_telemetry`, or `store_uploads` and `stream_ingest`, have written it."""
    day = T.StructField("ts_date", T.DateType())
    return spark.read.schema(T.StructType([*S.TELEMETRY.fields, day])).parquet(path).select(*COLUMNS, "ts_date")


def telemetry_scan(
    spark: SparkSession, path: str, start: datetime, end: datetime, site_id: str = "", robot_id: str | None = None
) -> DataFrame:
    """`[start, end)` of one site or robot: days are pruned, the rest is pushed to the files."""
    return site_feed(series_range(read_telemetry(spark, path), start, end, robot_id), site_id).drop("ts_date")


def quarantine(batches: DataFrame, now, path: str, mode: str = "append") -> None:
    """Keep the rejected rows with what was wrong with them."""
    bad = validate_samples(batches, now).where(~F.col("valid")).drop("valid")
    bad.write.mode(mode).partitionBy("reason").parquet(path)


def _cutoff(today: date, days: int) -> date:
    return today - timedelta(days=days)


def expire_partitions(table: DataFrame, today: date, keep_days: int = S.RETAIN_DAYS) -> DataFrame:
    """The table without days past retention; they are pruned, not read."""
    return table.where(F.col("ts_date") >= F.lit(_cutoff(today, keep_days)))


def drop_expired(spark: SparkSession, table: str, today: date, keep_days: int = S.RETAIN_DAYS) -> list[date]:
    """Drop the expired days of a catalog table.  Only partition names reach the driver: one a day."""
    names = [r.partition for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    days = [date.fromisoformat(n.split("=", 1)[1]) for n in names]
    old = sorted(d for d in days if d < _cutoff(today, keep_days))
    for d in old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (ts_date = DATE'{d}')")
    return old


def _manifests(spark: SparkSession, out: str) -> Folder:
    return Folder(spark, f"{out.rstrip('/')}/_compacted")


def compacted_days(spark: SparkSession, out: str) -> dict[date, str]:
    """The folder of every day that has been compacted: one entry a day."""
    folder = _manifests(spark, out)
    found: dict[date, str] = {}
    for name in folder.names("run-"):
        found |= {date.fromisoformat(day): where for day, where in json.loads(folder.read(name, last="}")).items()}
    return found


def compact_partitions(
    spark: SparkSession, path: str, out: str, today: date, after_days: int = S.COMPRESS_AFTER_DAYS
) -> list[date]:
    """Rewrite the days that have turned cold since the last run, clustered by site, robot and falling time; returns them.

    Each run writes a folder of its own under `out` and then a manifest that names its days, so readers see all of a run or nothing, and a
    run that fails changes nothing.  Days in a manifest are not looked at again: a second run reads no file.
    Range partitioning cuts a heavy day into several files instead of one task.  `read_compacted` reads cold days
    from here and the others from `path`, whose cold folders may then be dropped.
    """
    done = compacted_days(spark, out)
    table = read_telemetry(spark, path)
    cutoff = _cutoff(today, after_days)
    # Partition names alone answer this; at most one row a day reaches the driver.
    days = table.where((F.col("ts_date") < F.lit(cutoff)) & ~F.col("ts_date").isin(*done)) if done else table.where(F.col("ts_date") < F.lit(cutoff))
    cold = sorted(r.ts_date for r in days.select("ts_date").distinct().collect())
    if not cold:
        return []
    run = uuid.uuid4().hex
    clustered = (
        table.where(F.col("ts_date").isin(*cold))
        .repartitionByRange("ts_date", "site_id", "robot_id", "ts")
        .sortWithinPartitions("ts_date", "site_id", "robot_id", F.desc("ts"))
    )
    clustered.write.partitionBy("ts_date").parquet(f"{out.rstrip('/')}/{run}")
    folder = _manifests(spark, out)
    if set(cold) & set(compacted_days(spark, out)):
        raise RuntimeError("another run has compacted the same days; this one's folder is not used")
    number = len(folder.names("run-"))
    text = json.dumps({day.isoformat(): run for day in cold})
    while not folder.create(f"run-{number:09d}", text):
        number += 1
    return cold


def read_compacted(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The table with its compacted days from `out` and all others from `path`; days are pruned on both sides."""
    done = compacted_days(spark, out)
    recent = read_telemetry(spark, path)
    if not done:
        return recent
    recent = recent.where(~F.col("ts_date").isin(*done))
    cold = None
    for run in sorted(set(done.values())):
        part = read_telemetry(spark, f"{out.rstrip('/')}/{run}").where(F.col("ts_date").isin(*[d for d, r in done.items() if r == run]))
        cold = part if cold is None else cold.unionByName(part)
    return recent.unionByName(cold)
