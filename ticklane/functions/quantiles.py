"""Exact quantiles of large columns with bounded memory: passes that narrow ranges, in place of sorting or of keeping all values."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.sources.scratch import written

#: Parts that a pass cuts each range into, and values that are looked at one by one once a range has no more.
PARTS, FEW = 512, 2_000


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], by: str | None = None) -> dict[tuple, list[float | None]]:
    """{(group, column): the column's quantiles, interpolated between the neighbouring values}; the group is None without ``by``.

    ``by`` is a column of few values (bins, patterns), which the driver holds.  Null, NaN and infinite values are left out; a group
    without any value has None.  Each pass counts the values of the ranges where quantiles lie in PARTS equal parts and goes on with
    the parts they fall in, from their least to their greatest value; ranges of FEW values are listed.  A task holds the counts of the
    ranges, whatever the size of the table, and the driver PARTS rows a range; three passes do for billions of spread-out values.
    """
    spark = df.sparkSession
    columns = list(wanted)
    group = F.col(by) if by else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    values = written(df.select(group.alias("g"), F.inline(cells)).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')"), "quantiles")
    sizes = {(r.g, r.i): r for r in values.groupBy("g", "i").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    places, found, ranges = {}, {}, {}
    for (g, i), r in sizes.items():
        for q in wanted[columns[i]]:
            at = (r.n - 1) * q
            places[g, i, q] = (int(at), min(int(at) + 1, r.n - 1), at - int(at))
            for k in places[g, i, q][:2]:
                ranges.setdefault((g, i), {})[k] = (r.low, r.high, r.n, 0)
    while ranges:
        ask = sorted({(g, i, low, high, n, below) for (g, i), ks in ranges.items() for low, high, n, below in ks.values() if low < high}, key=repr)
        for (g, i), ks in ranges.items():
            found.update({(g, i, k): low for k, (low, high, _, _) in ks.items() if low == high})
        if not ask:
            break
        table = spark.createDataFrame([(k, *x[:5]) for k, x in enumerate(ask)], f"r int, g {values.schema['g'].dataType.simpleString()}, i int, low double, high double, size long")
        inside = values.join(F.broadcast(table), values["g"].eqNullSafe(table["g"]) & (values["i"] == table["i"]) & values["x"].between(table["low"], table["high"]))
        part = F.when(F.col("size") > FEW, F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * PARTS), F.lit(PARTS - 1)))
        counted = inside.groupBy("r", part.alias("part"), F.when(F.col("size") <= FEW, F.col("x")).alias("v")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        parts: dict[int, list] = {}
        for row in sorted(counted, key=lambda r: (r.r, r.low)):
            below = parts[row.r][-1][3] + parts[row.r][-1][2] if row.r in parts else ask[row.r][5]
            parts.setdefault(row.r, []).append((row.low, row.high, row.n, below))
        number = {x: k for k, x in enumerate(ask)}
        step: dict = {}
        for (g, i), ks in ranges.items():
            for k, x in ks.items():
                if x[0] < x[1]:
                    some = parts[number[g, i, *x]]
                    step.setdefault((g, i), {})[k] = some[bisect_right([p[3] for p in some], k) - 1]
        ranges = step
    out = {}
    for g, i in sizes:
        pairs = [(found[g, i, a], found[g, i, b], rest) for a, b, rest in (places[g, i, q] for q in wanted[columns[i]])]
        out[g, columns[i]] = [low + (high - low) * rest for low, high, rest in pairs]
    for c in columns:
        if not by:
            out.setdefault((None, c), [None] * len(wanted[c]))
    return out


def few_rows(spark: SparkSession, found: dict[tuple, list], column: str, names: list[str], by: str, kind: str) -> DataFrame:
    """The quantiles of a column as a row a group, to be broadcast: ``by`` and the names."""
    rows = [(g, *x) for (g, c), x in found.items() if c == column]
    return spark.createDataFrame(rows, ", ".join([f"{by} {kind}", *[f"{n} double" for n in names]]))
