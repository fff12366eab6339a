"""Quality rules on documents and on their hosts, in SQL expressions only.

A document fails by its own text: too few words, or most of them inside
three-word windows that the text repeats.  Rates of failure by host (`source`)
are shrunk with a beta prior whose mean and strength come from all hosts; a
host fails if even the low end of its shrunk rate is above a half, and then its
documents are not kept either.

The text is read once: the counts are written next to the columns that are kept,
host rates are summed per task before they meet, and the verdicts are joined back
on the host.  That join is Spark's choice by size, with its skew handling where
both sides are dealt out; a host with a third of all rows is no special case.

Null texts have no words and fail.  A null host has no verdict.  Repeated rows
count as often as they occur.  Empty tables give empty results.  Columns that
share a name with the counts are kept by `with_rules`, whose own columns are in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.llm.frames import fresh
from groundswell.llm.native import let, plain_words, total
from groundswell.plans.shared import materialize

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "[#*$%&|<>]"
MAX_HOST_RATE, Z = 0.5, 1.645
MAX_STRENGTH = 1e6


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Windows are compared by a 64-bit hash within one text; sorted with their places, equal ones are neighbours.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def places(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, i: F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, i + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))).cast("long")))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = let(ordered, lambda s: let(places(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(some)

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(hashes, count))


def counts(text: Column) -> Column:
    """The struct of counts that the rules look at."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n_symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    n_dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            n_symbols.cast("long").alias("n_symbols"),
            n_dup_lines.cast("long").alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
        )

    return let(plain_words(text), of_words)


def fails(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])


def host_verdicts(rows: DataFrame, host: str, failed: Column) -> DataFrame:
    """`(host, n, failures, rate, host_failed)` for every host that is not null; `rate` is the shrunk one."""
    hosts = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
    hosts = materialize(hosts.agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("failures")), "hosts")
    # Two moments over the hosts: one row, whatever their number.
    m = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("failures").alias("failures"), F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("squares")
    ).first()
    mean, strength = beta_prior(m.hosts or 0, m.n or 0, m.failures or 0, m.squares or 0.0)
    a, b = F.col("failures") + mean * strength, F.col("n") - F.col("failures") + (1 - mean) * strength
    rate = a / (a + b)
    low = rate - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "failures", rate.alias("rate"), (low > MAX_HOST_RATE).alias("host_failed"))


def beta_prior(hosts: int, n: int, failures: int, squares: float) -> tuple[float, float]:
    """Mean and strength (pseudo-documents) by moments: the spread of host rates beyond that of chance."""
    if not n:
        return 0.5, 1.0
    mean = failures / n
    noise = mean * (1 - mean) * hosts / n
    spread = squares / n - mean * mean - noise
    if spread <= 0:
        return mean, MAX_STRENGTH if mean * (1 - mean) > 0 else 1.0
    return mean, min(MAX_STRENGTH, max(1.0, mean * (1 - mean) / spread - 1))


def with_rules(docs: DataFrame, text: str = "text", host: str = "source", keep=None) -> tuple[DataFrame, str]:
    """`keep` (default: all columns) and a struct column, whose name is returned: the counts, base_failed, host_failed, kept."""
    name, key, flag = fresh(docs, "quality"), fresh(docs, "_host"), fresh(docs, "_host_failed")
    kept = list(docs.columns if keep is None else keep)
    rows = docs.select(*kept, F.col(host).alias(key), counts(F.col(text)).alias(name))
    rows = materialize(rows, "quality-counts")
    verdicts = host_verdicts(rows, key, fails(F.col(name))).select(F.col("host").alias(key), F.col("host_failed").alias(flag))
    judged = rows.join(verdicts, key, "left")
    host_failed = F.coalesce(F.col(flag), F.lit(False))
    c = F.col(name)
    verdict = F.struct(f"{name}.*", fails(c).alias("base_failed"), host_failed.alias("host_failed"), (~fails(c) & ~host_failed).alias("kept"))
    return judged.select(*kept, verdict.alias(name)), name


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns."""
    judged, name = with_rules(docs, **options)
    return judged.where(F.col(name)["kept"]).drop(name)
