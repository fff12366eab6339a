"""Secrets in texts, in SQL expressions only.

Three fixed patterns give the base spans.  Beyond them, tokens of at least 20
characters that mix letters and digits are tested for randomness in the
alphabet of their inferred encoding (hexadecimal, base32, base36, base62, base64):

* against randomness: chi-squared of symbol counts, runs above and below the middle
  of the alphabet, lag-1 serial correlation.  A token that fails any of them, with
  Bonferroni's correction, is not random;
* against ordinary text: its chi-squared is compared with what text of that length
  would give (from the letter concentration of all documents), and its changes
  between letters and digits with a Poisson bound.  Both p-values are joined by
  Fisher's rule.

The text p-values of all candidates of the corpus go through Benjamini and
Hochberg's procedure, apart for each length class, on a histogram of fixed bins
(rounded against discovery).  Accepted tokens are spans of kind `random`, unless base spans hold all of them.
A token that base spans hold in part is judged whole, and so is what they leave of it; accepted pieces count
where the whole is not accepted, so a key does not hide the secret that is glued to it.

Places are code points.  Texts are read once; per document only spans and
candidates are kept, and the histogram is summed per task, so nothing is skewed.
Null texts have no spans, repeated rows are judged each, empty tables stay empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.llm.frames import fresh
from groundswell.llm.native import found, let, total, total_double
from groundswell.plans.shared import materialize

# Kinds in the order of ties, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN_HEAD = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?"
)
ASSIGN = ASSIGN_HEAD + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_VALUE = 6

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
LONG_WORD = "[a-z]{16,}"
TEXT_CONCENTRATION = 0.066  # of English letters; only where the corpus has no long words
DIGIT_CONCENTRATION = 0.1
CHARS_PER_CHANGE = 8
FDR = 0.05
LIMIT = 3.588  # two-sided normal quantile for 0.001 over three tests
CLASSES = (32, 64)  # lengths at which the next class begins
BINS_PER_DECADE, MAX_DECADES = 10, 40

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
# (pattern, alphabet) in the order they are tried.
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans `(start, kind, end)` of the fixed patterns, in order. A matched assignment with a short value is dropped."""
    value = lambda m: F.length(F.regexp_extract(m["word"], ASSIGN, 2)) >= MIN_VALUE
    parts = [_spans(F.filter(found(text, ASSIGN), value), 0), _spans(found(text, ACCESS), 1), _spans(found(text, HEX), 2)]
    return F.sort_array(F.concat(*parts))


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; absolute error below 1e-7, lower tail bounded by exp(-z*z/2)/2."""
    # Fixed values of the formula.
    c = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

    def tail(x: Column) -> Column:
        t = 1 / (1 + 0.2316419 * x)
        poly = t * (c[0] + t * (c[1] + t * (c[2] + t * (c[3] + t * c[4]))))
        return F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly

    return let(F.abs(z), lambda x: F.when(z < 0, tail(x)).otherwise(1 - tail(x)))


def _candidates(text: Column) -> Column:
    return F.filter(found(text, CANDIDATE), lambda m: m["word"].rlike("[0-9]") & m["word"].rlike("[A-Za-z]"))


def _uncovered(token: Column, base: Column) -> Column:
    """The word of the token, with spaces for what base spans hold of it."""

    def blank(word: Column, s: Column) -> Column:
        at = F.greatest(s["start"], token["start"]) - token["start"]
        n = F.least(s["end"], token["end"]) - token["start"] - at
        return F.overlay(word, F.repeat(F.lit(" "), n.cast("int")), (at + 1).cast("int"), n.cast("int"))

    return F.aggregate(F.filter(base, lambda s: (s["start"] < token["end"]) & (token["start"] < s["end"])), token["word"], blank)


def _wholes(tokens: Column) -> Column:
    """What is judged, of `(m, rest)`: each token, at its own place in the array."""
    return F.transform(
        tokens,
        lambda t: F.struct(t["m"]["word"].alias("word"), t["m"]["start"].alias("start"), t["m"]["end"].alias("end"), F.lit(None).cast("int").alias("of"), (F.trim(t["rest"]) == "").alias("covered")),
    )


def _pieces(tokens: Column) -> Column:
    """What is judged, of `(m, rest)`: pieces that base spans leave, with the place `of` their token."""

    def pieces(t: Column, i: Column) -> Column:
        at = t["m"]["start"]
        return F.transform(
            F.when(t["rest"] != t["m"]["word"], _candidates(t["rest"])).otherwise(F.array().cast("array<struct<word:string,start:bigint,end:bigint>>")),
            lambda p: F.struct(p["word"].alias("word"), (at + p["start"]).alias("start"), (at + p["end"]).alias("end"), i.alias("of"), F.lit(False).alias("covered")),
        )

    return F.flatten(F.transform(tokens, pieces))


def _battery(word: Column, concentration: float) -> Column:
    """struct(random: passes the battery, p: probability that text looks as random)."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(word, "-_", "+/"), "=+$", ""), "=", "/")
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(bare.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def tests(s: Column) -> Column:
        n, k = F.size(s["v"]).cast("double"), s["k"]
        counts = F.transform(F.array_distinct(s["v"]), lambda c: F.size(F.filter(s["v"], lambda x: x == c)).cast("double"))
        chi = k / n * total_double(F.transform(counts, lambda c: c * c)) - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        high = total(F.transform(s["v"], lambda x: (2 * x >= k).cast("long"))).cast("double")
        changes = total(F.transform(s["v"], lambda x, i: F.coalesce(((2 * x >= k) != (2 * F.get(s["v"], i - 1) >= k)).cast("long"), F.lit(0).cast("long"))))
        twice = 2 * high * (n - high)
        z_runs = (changes - twice / n) / F.sqrt(F.greatest(twice * (twice - n) / (n * n * (n - 1)), F.lit(1e-9)))
        mean = total(F.transform(s["v"], lambda x: x.cast("long"))) / n
        spread = total_double(F.transform(s["v"], lambda x: (x - mean) * (x - mean)))
        serial = total_double(F.transform(s["v"], lambda x, i: F.coalesce((x - mean) * (F.get(s["v"], i - 1) - mean), F.lit(0.0))))
        z_serial = (serial / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        random = (z_chi <= LIMIT) & (F.abs(z_runs) <= LIMIT) & (F.abs(z_serial) <= LIMIT)
        # As text: symbols no more even than letters are (digits, in a hexadecimal alphabet), few changes of class.
        kappa = F.when(k == 16, F.lit(DIGIT_CONCENTRATION)).otherwise(F.lit(concentration))
        shift = (n - 1) * F.greatest(k * kappa - 1, F.lit(0.0))
        p_even = F.greatest(normal_cdf((chi - (k - 1) - shift) / F.sqrt(2 * (k - 1 + 2 * shift))), F.lit(1e-30))
        mu = n / CHARS_PER_CHANGE
        t = s["t"].cast("double")
        p_mixed = F.when(t <= mu, F.lit(1.0)).otherwise(F.greatest(F.exp(t - mu + t * F.log(mu / F.greatest(t, F.lit(1.0)))), F.lit(1e-30)))
        return let(p_even * p_mixed, lambda p: F.struct(random.alias("random"), F.least(p * (1 - F.log(p)), F.lit(1.0)).alias("p"), n.alias("n")))

    def symbols(a: Column) -> Column:
        values = F.transform(F.split(bare, ""), lambda c: F.position(c, a) - 1)
        flips = F.length(F.regexp_replace(F.regexp_replace(bare, "[0-9]+", "0"), "[^0-9]+", "a")) - 1
        return F.struct(values.alias("v"), F.length(a).cast("double").alias("k"), flips.alias("t"))

    return let(alphabet, lambda a: let(symbols(a), tests))


def text_concentration(docs: DataFrame, text: str) -> float:
    """Chance that two letters of one long word are equal, over the long words of all documents."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LONG_WORD), F.lit(0))

    def pairs(w: Column) -> Column:
        letters = F.array_distinct(F.split(w, ""))
        return total(F.transform(letters, lambda c: let((F.length(w) - F.length(F.replace(w, c, F.lit("")))).cast("long"), lambda n: n * (n - 1))))

    per_text = let(
        words,
        lambda ws: F.struct(
            total(F.transform(ws, pairs)).alias("equal"),
            total(F.transform(ws, lambda w: (F.length(w) * (F.length(w) - 1)).cast("long"))).alias("all"),
        ),
    )
    sums = docs.select(per_text.alias("s")).agg(F.sum("s.equal").alias("equal"), F.sum("s.all").alias("all")).first()
    return sums["equal"] / sums["all"] if sums["all"] else TEXT_CONCENTRATION


def _length_class(n: Column) -> Column:
    return sum((n >= edge).cast("int") for edge in CLASSES)


def _bin(p: Column) -> Column:
    """-log10 p in steps, rounded down: a bin stands for its largest p."""
    return F.least(F.floor(-F.log10(p) * BINS_PER_DECADE), F.lit(BINS_PER_DECADE * MAX_DECADES)).cast("int")


def least_bins(histogram: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Benjamini and Hochberg on `(class, bin, count)`: the lowest accepted bin of each class that has one."""
    out: dict[int, int] = {}
    for cls in {c for c, _, _ in histogram}:
        bins = sorted(((b, n) for c, b, n in histogram if c == cls), reverse=True)
        total_n, seen = sum(n for _, n in bins), 0
        for b, n in bins:
            seen += n
            if total_n * 10 ** (-b / BINS_PER_DECADE) / seen <= fdr:
                out[cls] = b
    return out


def with_secrets(docs: DataFrame, text: str = "text", keep=None) -> tuple[DataFrame, str, str]:
    """`keep` (default: all columns) and two columns, whose names are returned: base spans, and all spans."""
    kept = list(docs.columns if keep is None else keep)
    base, spans, tokens = fresh(docs, "base_spans"), fresh(docs, "spans"), fresh(docs, "_tokens")
    value = F.coalesce(F.col(text), F.lit(""))
    kappa = text_concentration(docs, text)

    def judged(m: Column) -> Column:
        return let(
            _battery(m["word"], kappa),
            lambda t: F.struct(
                *[m[c].alias(c) for c in ("start", "end", "of", "covered")], t["random"].alias("random"), _length_class(t["n"]).alias("cls"), _bin(t["p"]).alias("bin")
            ),
        )

    # One step for each depth of lambdas, which the analyzer bounds.
    rows = docs.select(*kept, base_spans(value).alias(base), _candidates(value).alias(tokens))
    rest = F.transform(F.col(tokens), lambda m: F.struct(m.alias("m"), _uncovered(m, F.col(base)).alias("rest")))
    rows = rows.select(*kept, base, rest.alias(tokens))
    rows = rows.select(*kept, base, F.concat(_wholes(F.col(tokens)), _pieces(F.col(tokens))).alias(tokens))
    rows = materialize(rows.select(*kept, base, F.transform(F.col(tokens), judged).alias(tokens)), "secrets")
    histogram = (
        rows.select(F.explode(tokens).alias("c"))
        .groupBy("c.cls", F.when(F.col("c.random"), F.col("c.bin")).otherwise(0).alias("bin"))
        .count()
        .collect()  # at most classes x bins rows
    )
    cut = least_bins([(r["cls"], r["bin"], r["count"]) for r in histogram])
    passes = lambda c: c["random"] & _at_least(c, cut)
    accepted = F.filter(F.col(tokens), lambda c: passes(c) & ~c["covered"] & (c["of"].isNull() | ~passes(F.get(F.col(tokens), c["of"]))))
    everything = F.sort_array(F.concat(F.col(base), F.transform(accepted, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))))
    return rows.select(*kept, base, everything.alias(spans)), base, spans


def _at_least(c: Column, cut: dict[int, int]) -> Column:
    passes = F.lit(False)
    for cls, b in cut.items():
        passes = passes | ((c["cls"] == cls) & (c["bin"] >= b))
    return passes


def listed(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced by `mask`. Null texts stay null."""
    rows, base, spans = with_secrets(docs, text)

    def step(s: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= s["at"], F.concat(F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.concat(s["out"], piece).alias("out"), F.greatest(s["at"], x["end"]).cast("int").alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text)))
    small = F.transform(F.col(spans), lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
    clean = F.when(F.size(spans) == 0, F.col(text)).otherwise(F.aggregate(small, start, step, rest))
    return rows.withColumn(text, clean).select(*docs.columns)
