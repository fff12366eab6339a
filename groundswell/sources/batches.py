"""JSON uploads and newline-delimited samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.functions.columns import parse_rfc3339
from groundswell.plans.shared import materialize
from groundswell.sources.ledger import Claim, Ledger

FIELDS = S.TEXT_FIELDS + S.NUMERIC_FIELDS
UPLOAD_SLOTS = 1 << 13  # numbers set aside for the samples of one upload; S.MAX_BATCH is less
_MISQUOTED = (
    '(?i)"(?:' + "|".join(S.NUMERIC_FIELDS) + r')"\s*:\s*"'
    + '|"(?:' + "|".join(S.TEXT_FIELDS) + r')"\s*:\s*[^"\sn]'
)


def _once(name: str, value: Column) -> Column:
    """Bind a costly value to a column that later filters cannot copy below themselves."""
    return F.explode(F.array(value)).alias(name)


def _plain_keys(m: Column) -> Column:
    """Keys in lower case, as fields are matched in any case; of keys that only differ in case the last one counts."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda i: F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(0)))
    last = F.filter(entries, lambda e, i: ~F.exists(later(i), lambda x: x["key"] == e["key"]))
    known = F.array(*[F.lit(f) for f in FIELDS])
    return F.when(F.size(F.array_except(F.map_keys(m), known)) > 0, F.map_from_entries(last)).otherwise(m)


def _typed(p: Column) -> Column:
    """The element's values, and `given`: the text of each number and of the time."""
    m = p["map"]
    numbers = [m[f].try_cast("double").alias(f) for f in S.NUMERIC_FIELDS]
    texts = [F.coalesce(m[f], F.lit("")).alias(f) for f in ("site_id", "robot_id", "state")]
    return F.struct(parse_rfc3339(m["ts"]).alias("ts"), *texts, *numbers, p.alias("given"))


def _broken(v: Column) -> Column:
    """A stray key, a wrong type, a time that cannot be read or a number that overflows."""
    given = v["given"]
    m = given["map"]
    known = F.array(*[F.lit(f) for f in FIELDS])
    broken = m.isNull() | (F.size(F.array_except(F.map_keys(m), known)) > 0) | given["misquoted"]
    broken = broken | (m["ts"].isNotNull() & v["ts"].isNull())
    for f in S.NUMERIC_FIELDS:
        broken = broken | (m[f].isNotNull() & (v[f].isNull() | ~(F.abs(v[f]) < float("inf"))))
    return given["text"].isNotNull() & F.coalesce(broken, F.lit(True))


def _decode(batches: DataFrame) -> DataFrame:
    """Add the upload's elements and `status`: ok, refused (0 or too many samples) or malformed.

    An upload stays one row: its elements are read as an array, each once, so that
    one bad leaf can refuse the whole without a shuffle.
    """
    strict = {"allowNonNumericNumbers": "false"}
    given = F.json_object_keys("body")
    # The usual spelling is read in one go; in any other case the list is looked up under its own key.
    other = F.try_element_at(F.filter(given, lambda k: F.lower(k) == "samples"), F.lit(-1))
    spelled = F.from_json(F.from_json("body", "map<string,string>", strict)[other], "array<string>", strict)
    listed = F.from_json("body", "struct<samples:array<string>>", strict)["samples"]
    body = F.struct(
        F.when(F.array_contains(given, "samples") | ~F.exists(given, lambda k: F.lower(k) == "samples"), listed).otherwise(spelled).alias("samples"),
        F.transform(given, F.lower).alias("keys"),
    )
    read = F.transform(
        F.coalesce("_body.samples", F.array().cast("array<string>")),
        lambda e: F.struct(
            e.alias("text"), F.from_json(e, "map<string,string>", strict).alias("map"), e.rlike(_MISQUOTED).alias("misquoted")
        ),
    )
    df = batches.select("*", _once("_body", body))
    df = df.select("*", _once("_read", read))
    plain = F.transform("_read", lambda p: F.struct(p["text"].alias("text"), _plain_keys(p["map"]).alias("map"), p["misquoted"].alias("misquoted")))
    df = df.withColumn("_plain", _once("_plain", plain)).drop("_read").withColumnRenamed("_plain", "_read")
    df = df.select("*", _once("_elements", F.transform("_read", _typed)))
    keys = F.col("_body.keys")
    not_a_list = (
        F.array_contains(keys, "samples") & F.col("_body.samples").isNull() & ~F.col("body").rlike(r'(?i)"samples"\s*:\s*null')
    )
    unreadable = keys.isNull() | (F.size(F.array_except(keys, F.array(F.lit("samples")))) > 0) | not_a_list
    malformed = (
        (F.octet_length("body") > S.MAX_BODY_BYTES)
        | F.coalesce(unreadable, F.lit(True))
        | F.exists("_elements", _broken)
    )
    n = F.size("_elements")
    status = F.when(malformed, "malformed").when((n == 0) | (n > S.MAX_BATCH), "refused").otherwise("ok")
    return df.select("*", _once("status", status)).drop("_body", "_read")


def batch_status(batches: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """`batch_id, status, samples` (samples that could be read; 0 for a malformed upload) and the columns `keep`."""
    n = F.when(F.col("status") == "malformed", 0).otherwise(F.size("_elements"))
    return _decode(batches).select("batch_id", "status", n.cast("long").alias("samples"), *keep)


def with_arrival(uploads: DataFrame) -> DataFrame:
    """Add `arrival`: an upload's place, from 0, in the order of `(received_at, batch_id)`."""
    return numbered_arrivals(uploads)[0]


def numbered_arrivals(uploads: DataFrame) -> tuple[DataFrame, int]:
    """`with_arrival` and the number of places.

    The uploads' keys are cut into ranges, each numbered on its own and shifted by
    the sizes of those before it; one row per range meets in one task.  Uploads of
    the same id and time have one number.
    """
    keys = uploads.select(F.col("received_at").alias("_at"), F.col("batch_id").alias("_id")).distinct()
    dealt = keys.repartitionByRange("_at", "_id").withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "arrivals")  # the cuts are sampled, so they must not be drawn again
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_at", "_id")) - 1
    numbers = dealt.withColumn("_place", place).join(offsets, "_range").select("_at", "_id", (F.col("_before") + F.col("_place")).alias("arrival"))
    same = F.col("received_at").eqNullSafe(F.col("_at")) & F.col("batch_id").eqNullSafe(F.col("_id"))
    return uploads.join(numbers, same).drop("_at", "_id"), dealt.count()


def sequenced_rows(uploads: DataFrame, first: int = 0) -> DataFrame:
    """`parse_batches` with `seq`, which counts from `first` in the order of arrival and then that inside an upload."""
    return _sequenced(with_arrival(uploads), first)


def _sequenced(arrived: DataFrame, first: int) -> DataFrame:
    rows = parse_batches(arrived, keep=["arrival"])
    return rows.withColumn("seq", F.col("arrival") * UPLOAD_SLOTS + F.col("index") + F.lit(first).cast("long")).drop("arrival")


def claimed_rows(uploads: DataFrame, ledger: Ledger, owner: str, epoch: int | None = None) -> tuple[DataFrame, Claim]:
    """`sequenced_rows` under numbers of the table's ledger; the claim is to be committed when the rows are stored."""
    arrived, n = numbered_arrivals(uploads)
    claim = ledger.claim(n * UPLOAD_SLOTS, owner, epoch)
    return _sequenced(arrived, claim.first), claim


def parse_batches(batches: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The samples of the readable uploads: `batch_id, received_at, index`, the sample's columns and the upload's columns `keep`."""
    return uploaded_rows(batches, keep).where(F.col("status") == "ok").drop("status")


def uploaded_rows(batches: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """`status`, and the columns of `parse_batches`; an upload that is not ok is one row without an index."""
    elements = F.when(F.col("status") == "ok", F.col("_elements"))
    rows = _decode(batches).select("batch_id", "received_at", *keep, "status", F.posexplode_outer(elements).alias("index", "v"))
    return rows.select(
        "batch_id",
        "received_at",
        *keep,
        "status",
        F.col("index").cast("long").alias("index"),
        "v.ts",
        "v.site_id",
        "v.robot_id",
        "v.state",
        *[F.coalesce(f"v.{f}", F.lit(0.0)).alias(f) for f in S.NUMERIC_FIELDS],
    )


_SAMPLE = "ts string, " + ", ".join([f"{f} string" for f in ("site_id", "robot_id", "state")] + [f"{f} double" for f in S.NUMERIC_FIELDS])
_CORRUPT = {"columnNameOfCorruptRecord": "_line"}


def read_samples_ndjson(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One sample per line; lines that cannot be read are in `corrupt_lines`."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.schema(f"{_SAMPLE}, _line string").options(**_CORRUPT).json(path)
    return lines.where(F.col("_line").isNull()).withColumn("ts", parse_rfc3339("ts")).drop("_line")


def corrupt_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The text (`line`) of what is not a sample: no JSON object, or a value of a wrong type."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")
    read = F.from_json("line", f"{_SAMPLE}, _line string", _CORRUPT)
    return lines.where(read.isNull() | read["_line"].isNotNull())
