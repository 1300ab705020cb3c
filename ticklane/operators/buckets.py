"""Quantile cuts by place, monthly frozen bucket maps, quality figures of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane.functions.base import c, div
from ticklane.functions.quantiles import exact_quantiles
from ticklane.functions.totals import running_totals
from ticklane.sources.scratch import written


def qcut(df: DataFrame, value: str, k: int, by: list[str] | None = None, tie: list[str] | None = None, name: str = "bin") -> DataFrame:
    """Bin 1..k of each row by the place of its value (ties by ``tie``): borders lie at 1 + (n - 1) j / k of the n places.

    Rows without a value are left out.  The borders are compared in whole numbers, so a place that meets one exactly
    belongs below it.  Without ``by`` places are counted range by range, so no task sees the whole table.
    """
    df = df.where(c(value).isNotNull())
    if by:
        part = W.partitionBy(*by)
        df = df.withColumns({"_r": F.row_number().over(part.orderBy(value, *(tie or []))), "_n": F.count(F.lit(1)).over(part)})
    else:
        df = running_totals(df.withColumn("_one", F.lit(1).cast("long")), value, {"_r": "_one"}, tie).withColumn("_r", F.col("_r") + 1)
        df = df.join(F.broadcast(df.agg(F.sum("_one").alias("_n"))), F.lit(True), "inner").drop("_one")  # one row
    above = sum(((F.col("_r") - 1) * k > (F.col("_n") - 1) * j).cast("int") for j in range(1, k))
    return df.withColumn(name, (F.lit(1) + above).cast("long")).drop("_r", "_n")


def monthly_freeze(bars: DataFrame, mode: str = "size", k: int = 3, places: int = 12) -> DataFrame:
    """code, bucket_id (0 .. k - 1) by each code's last month: its last close (size) or the deviation of its returns (vol).

    One row a code reaches the quantile cut.
    """
    if mode == "vol":
        line = W.partitionBy("code").orderBy("date")
        bars = bars.withColumn("_v", div("close", F.lag("close").over(line)) - 1)
        months = bars.groupBy("code", F.trunc("date", "month").alias("ym")).agg(F.round(F.stddev_samp("_v"), places).alias("v"))
    else:
        months = bars.groupBy("code", F.trunc("date", "month").alias("ym")).agg(F.max_by("close", "date").alias("v"))
    last = months.groupBy("code").agg(F.max_by("v", "ym").alias("v"))
    return qcut(last, "v", k, tie=["code"]).select("code", (F.col("bin") - 1).alias("bucket_id"))


def column_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rates of missing, non-positive and positive values and exact quantiles; one scan, and the passes of the quantiles."""
    df = written(df.select(*columns), "quality")
    cuts = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    found = exact_quantiles(df, {x: list(cuts.values()) for x in columns})
    share = lambda p: F.round(F.avg(F.coalesce(p, F.lit(False)).cast("int")), 6)
    one = lambda x: F.struct(
        F.lit(x).alias("metric"), F.count(F.lit(1)).alias("rows"), share(F.col(x).isNull()).alias("missing_rate"), share(F.col(x) <= 0).alias("non_positive_rate"),
        share(F.col(x) > 0).alias("positive_rate"), *[F.round(F.lit(v).cast("double"), 6).alias(n) for n, v in zip(cuts, found[None, x], strict=True)])
    return df.agg(F.array(*[one(x) for x in columns]).alias("_rows")).select(F.inline("_rows"))
