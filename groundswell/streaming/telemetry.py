"""Streaming twins of the telemetry operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.functions.columns import cell
from groundswell.operators.ingest import validate_samples
from groundswell.operators.timeseries import latest_per_robot
from groundswell.sources.batches import claimed_rows
from groundswell.sources.ledger import Ledger
from groundswell.sources.tables import COLUMNS, read_telemetry, write_epoch
from groundswell.streaming.sinks import run_epochs


def stream_ingest(uploads: DataFrame, accepted_path: str, quarantine_path: str, checkpoint: str, name: str = "ingest") -> None:
    """Parse, validate, append and quarantine; `received_at` is the clock, so a replay gives the same rows.

    The accepted table is cut by day and epoch and is read by `read_telemetry`.
    Both sinks own one folder per epoch (and day) and overwrite it on a retry.  `seq` comes from the table's ledger:
    it follows the epochs and, inside one, the order of arrival; a retried epoch gets its numbers again.
    Several streams may fill one table under different names; a replay under the same name replaces what was written.
    """
    ledger = Ledger(uploads.sparkSession, accepted_path)

    def write(batch: DataFrame, epoch: int) -> None:
        rows, claim = claimed_rows(batch, ledger, name, epoch)
        checked = validate_samples(rows, F.col("received_at")).persist()
        good = checked.where("valid").drop("valid", "reason", "error")
        bad = checked.where(~F.col("valid")).select("batch_id", "index", "reason", "error")
        write_epoch(good, accepted_path, f"{name}-{epoch}")
        bad.write.mode("overwrite").parquet(f"{quarantine_path}/epoch={name}-{epoch}")
        checked.unpersist()
        ledger.commit(claim)

    run_epochs(uploads, write, checkpoint, mode="append")


def stream_site_feed(samples: DataFrame, site_id: str = "") -> DataFrame:
    """Samples of one site as they arrive; all sites when none is named."""
    return samples.where(F.col("site_id") == site_id) if site_id else samples


class Feed(NamedTuple):
    seed: DataFrame
    follow: DataFrame
    mark: int


def site_feed(spark: SparkSession, table: str, site_id: str = "", mark: int | None = None) -> Feed:
    """What a viewer sees of a table that is being written: the latest samples, then every sample as it is stored.

    The table's ledger cuts it at `mark`, the number below which everything is stored: `seed` holds the newest sample
    per site and robot below the cut, `follow` streams all samples from the cut on, whether they were stored before or after the
    feed began.  So writes between the two are neither lost nor shown twice, and a range that is still being written
    when the feed begins is followed.  A viewer that comes back with its old `mark` and checkpoint goes on where it was.

    The stream lists the table's files; those with smaller numbers only are skipped by their statistics.
    """
    mark = Ledger(spark, table).mark() if mark is None else mark
    stored = read_telemetry(spark, table)
    seed = latest_per_robot(stream_site_feed(stored.where(F.col("seq") < mark), site_id).drop("ts_date"))
    arriving = spark.readStream.schema(stored.schema).parquet(table)
    follow = stream_site_feed(arriving.where(F.col("seq") >= mark), site_id).select(*COLUMNS)
    return Feed(seed, follow, mark)


def stream_latest(samples: DataFrame) -> DataFrame:
    """Newest sample per site and robot (update mode); late rows never roll it back."""
    rest = [c for c in samples.columns if c not in ("site_id", "robot_id")]
    best = F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("s")
    return samples.groupBy("site_id", "robot_id").agg(best).select("site_id", "robot_id", "s.*")


def stream_survey(samples: DataFrame) -> DataFrame:
    """Last arrival per site and cell (update mode)."""
    return samples.groupBy("site_id", cell("x_m").alias("cell_x"), cell("y_m").alias("cell_y")).agg(
        F.max_by("x_m", "seq").alias("x"),
        F.max_by("y_m", "seq").alias("y"),
        F.max_by("surface_uplift_mm", "seq").alias("uplift"),
        F.min("seq").alias("first_seq"),
    )
