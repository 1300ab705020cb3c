"""URL filters: allow and block rules first, gradient-boosted trees on lexical features for the rest.

DataFrame functions only.  Every feature lies on a grid of a few hundred values (counts by their logarithm), so bin borders are
exact quantiles of value counts.  The trees are grown on histograms that Spark aggregates over every labelled url: each level
of each tree is one group-by over (node, feature, bin), whose result has a fixed bound, and the finished trees are a CASE
expression.  Gradients are whole numbers (2**-20 units).  So nothing depends on how rows are ordered or partitioned.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the trees on
its (empty) features; without labelled urls, or with one class only, every url gets the prior; repeated rows and null ids
stay rows of their own; urls of any length are read whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm.shared import Scratch, join_totals

# The rules of the contract, (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

FEATURES = ("f_length", "f_host_length", "f_depth", "f_digit_ratio", "f_entropy", "f_params", "f_hyphens", "f_labels", "f_fragment", "f_suffix_share", "f_suffix_block")
BINS = 16
TREES = 8
DEPTH = 3
RATE = 0.3
UNIT = float(1 << 20)
LEAST_ROWS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and ruled, the verdict of the longest rule that fits host and path (null without one)."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        ruled = F.when(fits, F.lit(verdict)).otherwise(ruled)
    return df.withColumn("rule", rule).withColumn("ruled", ruled)


def _count(text: Column, piece: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits a character over letters, digits, some marks and one class for all else."""
    low = F.translate(text, _UPPER, _LOWER)
    size = F.length(low)
    marks = _LOWER + "0123456789-./_%=&?"
    counts = F.array(*[_count(low, c) for c in marks])
    counts = F.concat(counts, F.array(size - F.aggregate(counts, F.lit(0), lambda a, x: a + x)))
    bits = lambda a, n: a + F.when(n > 0, -(n / size) * F.log2(n / size)).otherwise(F.lit(0.0))
    return F.when(size > 0, F.aggregate(counts, F.lit(0.0), bits)).otherwise(F.lit(0.0))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of a url that need no other url, each on its grid, and its suffix."""
    many = lambda n: F.round(F.log2(n + F.lit(1.0)), 1)
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    tail = F.when(F.locate("?", url) > 0, F.substring(url, F.locate("?", url) + 1, F.length(url))).otherwise(F.lit(""))
    return df.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "f_length": many(F.length(url)),
        "f_host_length": many(F.length("host")),
        "f_depth": many(_count(F.col("path"), "/")),
        "f_digit_ratio": F.round(F.length(F.regexp_replace(url, "[^0-9]", "")) / size, 2),
        "f_entropy": F.round(F.round(_entropy(url), 6), 2),
        "f_params": many(F.when(tail == "", 0).otherwise(1) + _count(tail, "&")),
        "f_hyphens": many(_count(F.col("host"), "-")),
        "f_labels": many(_count(F.col("host"), ".")),
        "f_fragment": (F.locate("#", url) > 0).cast("double"),
    })


def suffix_statistics(df: DataFrame) -> DataFrame:
    """Share of all urls and smoothed block rate among the ruled ones, a row for each suffix."""
    stats = df.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("ruled") == "block").cast("long")).alias("blocked"), F.count("ruled").alias("labelled"))
    rate = (F.coalesce("blocked", F.lit(0)) + 50.0) / (F.col("labelled") + 100.0)
    return stats.select("suffix", "n", F.round(F.log2(F.col("n") + 1.0), 1).alias("f_suffix_share"), F.round(rate, 2).alias("f_suffix_block"))


def _leaf(total: tuple[int, int]) -> float:
    return -RATE * (total[0] / UNIT) / (total[1] / UNIT + 1.0)


def _case(node: dict) -> Column:
    if "value" in node:
        return F.lit(node["value"])
    return F.when(F.col(f"b{node['feature']}") <= node["bin"], _case(node["left"])).otherwise(_case(node["right"]))


def _best(found: dict, least: int) -> tuple | None:
    """The split of a node with the greatest gain: (feature, bin, left sums, right sums). found: (feature, bin) -> (g, h, n)."""
    score = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + 1.0)
    best, gain = None, 1e-6
    for feature in range(len(FEATURES)):
        column = sorted((b, v) for (f, b), v in found.items() if f == feature)
        total = [sum(v[i] for _, v in column) for i in range(3)]
        left = [0, 0, 0]
        for b, v in column[:-1]:
            left = [x + y for x, y in zip(left, v, strict=True)]
            right = [x - y for x, y in zip(total, left, strict=True)]
            rise = score(*left[:2]) + score(*right[:2]) - score(*total[:2])
            if left[2] >= least and right[2] >= least and rise > gain:
                best, gain = (feature, b, tuple(left[:2]), tuple(right[:2])), rise
    return best


def edges(labelled: DataFrame) -> list[list[float]]:
    """Bin borders of each feature: its distinct quantiles, exactly. What reaches the driver is a count for each grid value."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("v")) for i, f in enumerate(FEATURES)]))
    counts = labelled.select(cells.alias("c")).groupBy("c.f", "c.v").agg(F.count(F.lit(1)).alias("n")).collect()
    out = []
    for i in range(len(FEATURES)):
        column = sorted((r.v, r.n) for r in counts if r.f == i)
        total, passed, cuts = sum(n for _, n in column), 0, set()
        for value, n in column:  # the value of rank ceil(total * k / BINS)
            if any(passed < -(-total * k // BINS) <= passed + n for k in range(1, BINS)):
                cuts.add(value)
            passed += n
        out.append(sorted(cuts))
    return out


def binned(df: DataFrame, borders: list[list[float]]) -> DataFrame:
    one = lambda f, cuts: sum([(F.col(f) > c).cast("int") for c in cuts], F.lit(0)) if cuts else F.lit(0)
    return df.withColumns({f"b{i}": one(f, cuts) for i, (f, cuts) in enumerate(zip(FEATURES, borders, strict=True))})


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list[dict]]:
    """Prior log-odds and trees for binned rows with a column y (1: block).

    What reaches the driver is at most nodes * features * bins sums a level, whatever the rows are.
    """
    n, ones = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = math.log((ones + 1.0) / (n - ones + 1.0))
    grown: list[dict] = []
    if ones in (0, n):
        return prior, grown
    for _ in range(trees):
        margin = sum([_case(t) for t in grown], F.lit(prior))
        p = 1.0 / (1.0 + F.exp(-margin))
        rows = labelled.withColumns({"_g": F.round((p - F.col("y")) * UNIT).cast("long"), "_h": F.round(p * (1 - p) * UNIT).cast("long")})
        root: dict = {"value": 0.0}
        leaves = [root]
        for _ in range(depth):
            for k, leaf in enumerate(leaves):
                leaf["value"] = float(k)
            pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").alias("b")) for i in range(len(FEATURES))]))
            level = rows.select(_case(root).cast("int").alias("node"), "_g", "_h", pairs.alias("p"))
            sums = level.groupBy("node", "p.f", "p.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count(F.lit(1)).alias("n")).collect()
            fresh = []
            for k, leaf in enumerate(leaves):
                split = _best({(r.f, r.b): (r.g, r.h, r.n) for r in sums if r.node == k}, LEAST_ROWS)
                if split is None:
                    continue
                leaf.pop("value")
                leaf |= {"feature": split[0], "bin": split[1], "left": {"value": 0.0, "sums": split[2]}, "right": {"value": 0.0, "sums": split[3]}}
                fresh += [leaf["left"], leaf["right"]]
            _settle(root)
            if not fresh:
                break
            leaves = _leaves(root)
        grown.append(root)
    return prior, grown


def _leaves(node: dict) -> list[dict]:
    return [node] if "value" in node else _leaves(node["left"]) + _leaves(node["right"])


def _settle(root: dict) -> None:
    for leaf in _leaves(root):
        leaf["value"] = _leaf(leaf["sums"]) if "sums" in leaf else 0.0


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (chance of block by the trees) of every page (page_id, url)."""
    scratch = Scratch(pages.sparkSession, "urls")
    df = pages.select("page_id", "url")
    host, path = split_url(F.col("url"))
    df = lexical(with_rule(df.withColumn("host", host).withColumn("path", path), rules))
    df = scratch.cut(df.drop("url"))
    stats = scratch.cut(suffix_statistics(df))
    df = join_totals(df, stats, ["suffix"], "n", df.count()).drop("suffix", "n")
    labelled = df.where(F.col("ruled").isNotNull()).withColumn("y", (F.col("ruled") == "block").cast("int"))
    borders = edges(labelled)
    rows = scratch.cut(binned(labelled, borders).select("y", *[f"b{i}" for i in range(len(FEATURES))]))
    prior, trees = train(rows)
    margin = sum([_case(t) for t in trees], F.lit(prior))
    df = binned(df, borders).withColumn("score", 1.0 / (1.0 + F.exp(-margin)))
    said = F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", said.alias("verdict"), F.round("score", 6).alias("score"))
