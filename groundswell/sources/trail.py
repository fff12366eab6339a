"""The stored command trail: the log is replayed when it has grown, and every view reads tables.

A trail is a folder of generations, each an audit trail, the refused requests, the state of every command and the newest polls,
written from one state of the log.  A small manifest per generation names the state of the log it stands for; readers take the
newest one, so they never see half a generation, and a replay that fails leaves the old one in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.operators import commands as C
from groundswell.plans.shared import materialize
from groundswell.sources.folder import Folder

class StoredTrail:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, f"{self.path}/_manifests")

    def newest(self) -> dict | None:
        names = self.folder.names("generation-")
        return json.loads(self.folder.read(names[-1], last="}")) if names else None

    def refresh(self, requests: DataFrame, source: DataFrame | None = None) -> StoredTrail:
        """Replay `requests` unless the newest generation was made from the same rows; returns itself.

        `source` is the table that the log is derived from, if that costs less to look through.
        """
        looked_at = requests if source is None else source
        # One narrow pass: the number of rows and an order-free digest of them.
        seen = looked_at.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*looked_at.columns)).alias("digest")).first()
        state = {"rows": seen["rows"], "digest": seen["digest"]}
        last = self.newest()
        if last is not None and last["log"] == state:
            return self
        where = f"{self.path}/{uuid.uuid4().hex}"
        # The log is a view; the replay, the flows and the polls read one copy of it.
        requests = materialize(requests, "requests")
        audit, errors = C.replay_commands(requests, stored=True)
        # Arrival order, so that the newest entries and ranges of time are in few row groups.
        audit.repartitionByRange("order_seq").sortWithinPartitions("order_seq", "phase", "ordinal").write.parquet(f"{where}/audit")
        errors.write.parquet(f"{where}/errors")
        stored = self.spark.read.parquet(f"{where}/audit")
        C.commands_table(stored, requests).repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(f"{where}/commands")
        polls = requests.where(F.col("kind") == "next").groupBy("kind", "robot_id").agg(F.max("at").alias("at"))
        polls.write.parquet(f"{where}/polls")
        number = 0 if last is None else last["number"] + 1
        while not self.folder.create(f"generation-{number:09d}", json.dumps({"number": number, "path": where, "log": state})):
            number += 1
        return self

    def _read(self, name: str) -> DataFrame:
        last = self.newest()
        if last is None:
            raise FileNotFoundError(f"no trail in {self.path}; call refresh first")
        return self.spark.read.parquet(f"{last['path']}/{name}")

    @property
    def audit(self) -> DataFrame:
        return self._read("audit")

    @property
    def errors(self) -> DataFrame:
        return self._read("errors")

    @property
    def polls(self) -> DataFrame:
        """The newest poll of each robot, as a request; all that `robot_links` and `known_robots` look at."""
        return self._read("polls")

    @property
    def commands(self) -> DataFrame:
        return self._read("commands")
