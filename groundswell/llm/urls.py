"""URL filters in SQL expressions: host rules first, boosted trees for the rest.

Rules name a host and a path; a rule fits the host and its subdomains if the
path begins with the rule's, and the longest fitting rule decides.  URLs that a rule decides are
the labelled ones.  A bounded sample of them (`TRAIN_ROWS`, those with the least hash)
trains gradient-boosted trees for the logistic loss: features are lexical (lengths,
depth, share of digits, entropy, parameters, and how often the suffix is allowed
among the labelled URLs), cut into at most `BINS` bins; every level of a tree is one
grouped sum over the sample, and only that histogram reaches the driver.  The trees
are then one expression over all URLs: no shuffle, so hosts cannot be hot.

A null URL, or one without `://`, has an empty host and path and no rule; the trees judge it by its
features. Without labelled URLs everything is allowed. Repeated rows are judged each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.llm.frames import fresh
from groundswell.llm.native import let, total_double
from groundswell.plans.shared import materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
TRAIN_ROWS, BINS, TREES, DEPTH, RATE, MIN_LEAF, RIDGE = 20_000, 16, 10, 2, 0.3, 20, 1.0
FEATURES = ("url_chars", "host_chars", "path_chars", "labels", "depth", "digit_share", "entropy", "params", "hyphens", "suffix_rate")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def decide(rules, host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(fits(r, host, path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def features(url: Column, host: Column, path: Column, suffix_rate: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    n = F.length(url).cast("double")

    def share(c: Column) -> Column:
        p = (n - F.length(F.replace(url, c, F.lit("")))) / n
        return -p * F.log2(p)

    entropy = F.when(n == 0, F.lit(0.0)).otherwise(total_double(F.transform(F.array_distinct(F.split(url, "")), share)))
    count = lambda s, c: (F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("double")
    query = F.instr(url, "?") > 0
    values = {
        "url_chars": n,
        "host_chars": F.length(host).cast("double"),
        "path_chars": F.length(path).cast("double"),
        "labels": count(host, "."),
        "depth": count(path, "/"),
        "digit_share": F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(url, "[0-9]", ""))) / n),
        "entropy": entropy,
        "params": F.when(query, count(url, "&") + 1).otherwise(0.0),
        "hyphens": count(host, "-"),
        "suffix_rate": suffix_rate,
    }
    return F.struct(*[values[f].alias(f) for f in FEATURES])


@dataclass(frozen=True)
class Node:
    """A split `feature < cut`, or a leaf with a value."""

    value: float = 0.0
    feature: str | None = None
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None

    def score(self, f: Column) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(f[self.feature] < self.cut, self.low.score(f)).otherwise(self.high.score(f))


@dataclass(frozen=True)
class Model:
    """`bias` plus the trees, in log-odds of allow; `rates` are the suffixes' smoothed shares of allow."""

    bias: float
    trees: tuple[Node, ...]
    rates: dict[str, float]
    prior: float

    def suffix_rate(self, host: Column) -> Column:
        if not self.rates:
            return F.lit(self.prior)
        table = F.create_map(*[F.lit(x) for pair in sorted(self.rates.items()) for x in pair])
        return F.coalesce(F.try_element_at(table, suffix_of(host)), F.lit(self.prior))

    def log_odds(self, f: Column) -> Column:
        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + tree.score(f)
        return out


def _grow(binned: DataFrame, margin: Column, cuts: dict[str, list[float]]) -> Node:
    """One tree on the gradients at `margin`; a grouped sum for each level."""
    p = 1 / (1 + F.exp(-margin))
    rows = binned.select("f", "b", (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"))
    splits: dict[int, tuple[str, int]] = {}
    values: dict[int, float] = {}

    def node_of(f: Column) -> Column:
        node = F.lit(1)
        for _ in range(DEPTH):
            deeper = F.lit(0)
            for k, (feature, cut) in splits.items():
                deeper = F.when(node == k, F.when(f[feature] < cuts[feature][cut], 2 * k).otherwise(2 * k + 1)).otherwise(deeper)
            node = let(F.when(deeper == 0, node).otherwise(deeper), lambda x: x)
        return node

    for level in range(DEPTH):
        cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("b")[name].alias("bin")) for i, name in enumerate(FEATURES)])).alias("c")
        sums = rows.select(node_of(F.col("f")).alias("node"), "g", "h", cell).groupBy("node", "c.i", "c.bin")
        cells = sums.agg(F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # nodes x features x bins
        for k in sorted({c.node for c in cells if c.node >= 2**level}):
            best = (1e-6, None)
            for i, name in enumerate(FEATURES):
                mine = sorted((c.bin, c.n, round(c.g, 9), round(c.h, 9)) for c in cells if c.node == k and c.i == i)
                n, g, h = (sum(c[j] for c in mine) for j in (1, 2, 3))
                values[k] = round(RATE * g / (h + RIDGE), 6)
                left = [0, 0.0, 0.0]
                for bin_, *parts in mine[:-1]:
                    left = [a + b for a, b in zip(left, parts)]
                    if min(left[0], n - left[0]) < MIN_LEAF or bin_ >= len(cuts[name]):
                        continue
                    gain = left[1] ** 2 / (left[2] + RIDGE) + (g - left[1]) ** 2 / (h - left[2] + RIDGE) - g * g / (h + RIDGE)
                    if gain > best[0] + 1e-9:
                        low, high = left[1] / (left[2] + RIDGE), (g - left[1]) / (h - left[2] + RIDGE)
                        best = (gain, (name, bin_, low, high))
            if best[1]:
                name, bin_, low, high = best[1]
                splits[k] = (name, bin_)
                values[2 * k], values[2 * k + 1] = round(RATE * low, 6), round(RATE * high, 6)

    def build(k: int) -> Node:
        if k not in splits:
            return Node(values.get(k, 0.0))
        name, bin_ = splits[k]
        return Node(0.0, name, cuts[name][bin_], build(2 * k), build(2 * k + 1))

    return build(1)


def train(labelled: DataFrame, url: str, host: str, path: str, label: str, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `train_rows` labelled URLs, those with the least hash of the URL."""
    picked = labelled.select(url, host, path, (F.col(label) == "allow").cast("double").alias("y")).orderBy(F.xxhash64(url), url).limit(train_rows)
    sample = materialize(picked.withColumnsRenamed({url: "url", host: "host", path: "path"}), "url-sample")
    by_suffix = sample.groupBy(suffix_of(F.col("host")).alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()  # at most the sample
    n, positive = sum(r.n for r in by_suffix), sum(r.y for r in by_suffix)
    if not n:
        return Model(0.0, (), {}, 0.5)
    prior = positive / n
    rates = {r.s: round((r.y + 10 * prior) / (r.n + 10), 6) for r in by_suffix}
    odds = min(max(prior, 1e-3), 1 - 1e-3)
    model = Model(math.log(odds / (1 - odds)), (), rates, prior)
    rows = materialize(sample.select("y", features(F.col("url"), F.col("host"), F.col("path"), model.suffix_rate(F.col("host"))).alias("f")), "url-features")
    edges = rows.agg(*[F.percentile(F.col("f")[f], [i / BINS for i in range(1, BINS)]).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({x for x in edges[f]}) for f in FEATURES}
    bins = F.struct(*[total_bins(F.col("f")[f], cuts[f]).alias(f) for f in FEATURES])
    binned = materialize(rows.select("y", "f", bins.alias("b")), "url-bins")
    for _ in range(TREES):
        tree = _grow(binned, let(F.col("f"), model.log_odds), cuts)
        if tree.feature is None:
            break
        model = Model(model.bias, (*model.trees, tree), rates, prior)
    return model


def total_bins(value: Column, cuts: list[float]) -> Column:
    """The number of cuts at or below `value`: bin b is left of cut b."""
    return sum(((value >= c).cast("int") for c in cuts), F.lit(0))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, keep=None, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, str]:
    """`keep` (default: all columns) and a struct column, whose name is returned: host, path, rule, verdict, allow_score."""
    kept = list(pages.columns if keep is None else keep)
    name = fresh(pages, "judged")
    parts = let(
        F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")),
        lambda x: F.struct(x["host"].alias("host"), x["path"].alias("path"), decide(rules, x["host"], x["path"]).alias("decided")),
    )
    seen = pages.select(parts.alias("p"), F.col(url).alias("url")).where("p.decided is not null")
    labelled = seen.select("url", F.col("p.host").alias("host"), F.col("p.path").alias("path"), F.col("p.decided.verdict").alias("label"))
    model = train(labelled, "url", "host", "path", "label", train_rows)

    def judged(x: Column) -> Column:
        f = features(F.col(url), x["host"], x["path"], model.suffix_rate(x["host"]))
        score = let(f, lambda v: 1 / (1 + F.exp(-model.log_odds(v))))
        return let(
            score,
            lambda s: F.struct(
                x["host"].alias("host"),
                x["path"].alias("path"),
                x["decided"]["rule"].alias("rule"),
                F.coalesce(x["decided"]["verdict"], F.when(s >= 0.5, F.lit("allow")).otherwise("block")).alias("verdict"),
                s.alias("allow_score"),
            ),
        )

    return pages.select(*kept, let(parts, judged).alias(name)), name
