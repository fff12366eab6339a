from __future__ import annotations

import shutil
from datetime import date, datetime, timedelta

import pytest
from conftest import SMALL, utc
from test_timeseries import frame

from pyspark.sql import functions as F

from groundswell.operators import ingest
from groundswell.plans.shared import store
from groundswell.sources import adapters as A
from groundswell.sources import tables
from groundswell.sources.batches import claimed_rows
from groundswell.sources.ledger import Ledger
from groundswell.streaming import sinks
from groundswell.streaming import telemetry as st

T0 = utc("2024-01-01 00:00:00")


def rows(days=20, per_day=6):
    return [
        dict(ts=T0 + timedelta(days=d, hours=h * 3), robot_id=f"r{h % 2}", site_id=f"site-{h % 3}") for d in range(days) for h in range(per_day)
    ]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_write_and_pruned_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    df = frame(spark, rows())
    tables.write_telemetry(df, path)
    tables.write_telemetry(df.limit(1), path)
    assert tables.read_telemetry(spark, path).count() == 121, "a sample that is sent again is kept again"
    part = tables.telemetry_scan(spark, path, datetime(2024, 1, 3, 6), datetime(2024, 1, 5), "site-0", "r0")
    # Robot r0 on site-0 reports at midnight only, and the range starts after one and ends before another.
    assert sorted(r.seq for r in part.collect()) == [18]
    text = plan(part)
    assert "PartitionFilters: [isnotnull(ts_date" in text and "PushedFilters: [IsNotNull(ts)" in text


def test_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_telemetry(frame(spark, rows()), path)
    kept = tables.expire_partitions(tables.read_telemetry(spark, path), date(2024, 1, 20), keep_days=5)
    assert kept.agg({"ts_date": "min"}).first()[0] == date(2024, 1, 15)
    assert "PartitionFilters: [isnotnull(ts_date" in plan(kept)


def test_drop_expired(spark):
    df = frame(spark, rows()).selectExpr("*", "to_date(ts) AS ts_date")
    df.write.partitionBy("ts_date").mode("overwrite").saveAsTable("telemetry_days")
    dropped = tables.drop_expired(spark, "telemetry_days", date(2024, 1, 20), keep_days=5)
    assert dropped == [date(2024, 1, d) for d in range(1, 15)]
    assert spark.table("telemetry_days").count() == 6 * 6


def test_compaction_keeps_the_content(spark, tmp_path):
    path, out = str(tmp_path / "t"), str(tmp_path / "c")
    tables.write_telemetry(frame(spark, rows()), path)
    assert tables.read_compacted(spark, path, out).count() == 120
    days = tables.compact_partitions(spark, path, out, date(2024, 1, 20))
    assert days == [date(2024, 1, d) for d in range(1, 13)]
    before, after = tables.read_telemetry(spark, path), tables.read_compacted(spark, path, out)
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))


def test_a_second_compaction_reads_nothing(spark, tmp_path, monkeypatch):
    path, out = str(tmp_path / "t"), str(tmp_path / "c")
    tables.write_telemetry(frame(spark, rows()), path)
    tables.compact_partitions(spark, path, out, date(2024, 1, 20))
    files = sorted(str(p) for p in (tmp_path / "c").rglob("*.parquet"))
    assert tables.compact_partitions(spark, path, out, date(2024, 1, 20)) == []
    assert tables.compact_partitions(spark, path, out, date(2024, 1, 22)) == [date(2024, 1, 13), date(2024, 1, 14)]
    grown = sorted(str(p) for p in (tmp_path / "c").rglob("*.parquet"))
    assert set(files) < set(grown) and len({p.split("/")[-3] for p in grown}) == 2
    table = tables.read_telemetry(spark, path)
    want = sorted(map(tuple, table.collect()))
    shutil.rmtree(tmp_path / "t" / "ts_date=2024-01-05")  # retention of the raw side
    spark.catalog.refreshByPath(path)
    assert sorted(map(tuple, tables.read_compacted(spark, path, out).collect())) == want
    one = tables.read_compacted(spark, path, out).where("ts_date = DATE'2024-01-03'")
    assert one.count() == 6 and plan(one).count("PartitionFilters: [isnotnull(ts_date") >= 1


def test_a_failed_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    path, out = str(tmp_path / "t"), str(tmp_path / "c")
    tables.write_telemetry(frame(spark, rows()), path)

    def broken(*_, **__):
        raise OSError("disk full")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(tables.Folder, "create", broken)  # after the files, before the manifest
        tables.compact_partitions(spark, path, out, date(2024, 1, 20))
    assert tables.compacted_days(spark, out) == {} and tables.read_compacted(spark, path, out).count() == 120
    assert len(tables.compact_partitions(spark, path, out, date(2024, 1, 20))) == 12
    assert tables.read_compacted(spark, path, out).count() == 120


def test_ledger_ranges(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "t"))
    assert ledger.mark() == 0 and ledger.claims() == []
    first = ledger.claim(10, "call")
    epoch = ledger.claim(5, "stream", 0)
    assert (first.first, first.end, epoch.first, epoch.end) == (0, 10, 10, 15)
    other = Ledger(spark, str(tmp_path / "t"))
    assert other.claim(5, "stream", 0) == epoch, "a repeated epoch has its numbers again"
    assert other.claim(6, "stream", 0).first == 15, "a repeated epoch that has grown takes new ones"
    third = other.claim(0, "call")
    ledger.commit(epoch)
    assert ledger.mark() == 0, "the first range is still being written"
    ledger.void(first)
    ledger.void(first)
    assert ledger.mark() == 15
    for claim in ledger.claims():
        ledger.commit(claim)
    assert ledger.mark() == 21 == third.end


def test_two_writers_of_one_place(spark, tmp_path):
    """The claim that comes second moves on to the next place."""
    a, b = (Ledger(spark, str(tmp_path / "t")) for _ in range(2))
    seen = b._names
    b._names = lambda: [n for n in seen() if n != "claim-000000000001"]  # as if listed before the other's claim
    a.claim(3, "x")
    a.claim(4, "y")
    assert (late := b.claim(5, "z")).number == 2 and late.first == 7


def test_calls_and_a_stream_fill_one_table(spark, tmp_path):
    uploads = A.sample_batches(spark, SMALL).select("batch_id", "body", "received_at")
    parts = [uploads.where(F.col("batch_id") % 3 == k) for k in range(3)]
    path = str(tmp_path / "t")

    def new_rows(before):
        now = tables.read_telemetry(spark, path)
        return {r.seq for r in now.select("seq").collect()} - before

    tables.store_uploads(parts[0], A.now(), path)
    one = new_rows(set())
    source = spark.readStream.schema(uploads.schema).option("maxFilesPerTrigger", 1).parquet(store(parts[1].repartition(2), "uploads"))
    st.stream_ingest(source, path, str(tmp_path / "bad"), str(tmp_path / "cp"))
    two = new_rows(one)
    tables.store_uploads(parts[2], A.now(), path)
    three = new_rows(one | two)
    assert one and two and three and max(one) < min(two) and max(two) < min(three)
    n = tables.read_telemetry(spark, path).count()
    whole = str(tmp_path / "whole")
    tables.store_uploads(uploads, A.now(), whole)
    assert n == len(one) + len(two) + len(three) == tables.read_telemetry(spark, whole).count()
    assert Ledger(spark, path).mark() > max(three)


def test_a_failed_call_gives_its_numbers_up(spark, tmp_path, monkeypatch):
    uploads = A.sample_batches(spark, SMALL).select("batch_id", "body", "received_at")
    path = str(tmp_path / "t")

    def broken(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(tables, "write_epoch", broken)
        tables.store_uploads(uploads, A.now(), path)
    tables.store_uploads(uploads, A.now(), path)
    claims = Ledger(spark, path).claims()
    least = tables.read_telemetry(spark, path).agg({"seq": "min"}).first()[0]
    assert len(claims) == 2 and claims[1].first <= least and Ledger(spark, path).mark() == claims[1].end


def test_feed_shows_every_stored_sample_once(spark, tmp_path):
    """Writes before the feed, one that is under way when it begins, and writes between its two halves."""
    uploads = A.sample_batches(spark, SMALL).select("batch_id", "body", "received_at")
    parts = [uploads.where(F.col("batch_id") % 4 == k) for k in range(4)]
    path = str(tmp_path / "t")
    tables.store_uploads(parts[0], A.now(), path)
    ledger = Ledger(spark, path)
    rows, under_way = claimed_rows(parts[1], ledger, "slow")
    tables.store_uploads(parts[2], A.now(), path)
    feed = st.site_feed(spark, path, "site-1")
    assert feed.mark == under_way.first
    seed = feed.seed.collect()
    tables.write_epoch(ingest.accepted_samples(rows, A.now()), path, "slow")
    ledger.commit(under_way)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    sinks.run_to_table(feed.follow, out, checkpoint)
    tables.store_uploads(parts[3], A.now(), path)
    back = st.site_feed(spark, path, "site-1", mark=feed.mark)
    sinks.run_to_table(back.follow, out, checkpoint)
    table = [r for r in tables.read_telemetry(spark, path).collect() if r.site_id == "site-1"]
    before = [r for r in table if r.seq < feed.mark]
    followed = [r.seq for r in spark.read.schema(feed.follow.schema).parquet(out).collect()]
    assert sorted(followed) == sorted(r.seq for r in table if r.seq >= feed.mark) and followed
    newest = {}
    for r in before:
        newest[r.robot_id] = max(newest.get(r.robot_id, (r.ts, r.seq)), (r.ts, r.seq))
    assert {(r.robot_id, (r.ts, r.seq)) for r in seed} == set(newest.items()) and newest
