"""Small expression builders for operators that stay inside Spark SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where the optimizer would copy it into every use."""
    return F.transform(F.array(value), body)[0]


def plain_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def total_double(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def running(numbers: Column) -> Column:
    """Sum of the numbers before each one, in blocks, so that long arrays do not cost their square."""

    def with_blocks(lengths: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
            lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))),
        )

        def with_bases(sums: Column) -> Column:
            bases = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
            return let(
                bases,
                lambda base: F.transform(
                    lengths,
                    lambda _, i: F.get(base, F.floor(i / _BLOCK).cast("int"))
                    + total(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)),
                ),
            )

        return let(blocks, with_bases)

    empty = F.array().cast("array<bigint>")
    return let(numbers, lambda n: F.when(F.size(n) == 0, empty).otherwise(with_blocks(n)))


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<word, start, end>>, in code points.

    The pieces between matches and the matches themselves add up to the text, so
    their lengths give the places.
    """

    def places(match: Column, gap: Column) -> Column:
        steps = F.transform(match, lambda m, i: (F.length(m) + F.length(F.get(gap, i))).cast("long"))
        return let(
            running(steps),
            lambda before: F.transform(
                match,
                lambda m, i: let(
                    F.get(before, i) + F.length(F.get(gap, i)),
                    lambda start: F.struct(m.alias("word"), start.alias("start"), (start + F.length(m)).alias("end")),
                ),
            ),
        )

    hit = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda g: places(m, g)))
    return F.when(text.rlike(pattern), hit).otherwise(F.array().cast("array<struct<word:string,start:bigint,end:bigint>>"))
