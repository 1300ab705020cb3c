"""Running sums over a whole table in one order, range by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane.sources.scratch import scratch_path


def running_totals(df: DataFrame, order: str, sums: dict[str, str], tie: list[str] | None = None) -> DataFrame:
    """df with, for each name -> column, the sum of the column over all rows before a row in the order of ``order`` (then ``tie``).

    No window sees the whole table: rows are dealt to ranges of the order, summed within each, and each range is given the
    totals of those before it, one row a range.  The ranges, which Spark picks by sampling, are written once.
    """
    keys = [order, *(tie or [])]
    path = scratch_path(df.sparkSession, "ranges")
    df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    line = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    inner = dealt.withColumns({f"_i_{n}": F.coalesce(F.sum(x).over(line), F.lit(0)) for n, x in sums.items()})
    parts = dealt.groupBy("_part").agg(*[F.sum(x).alias(f"_s_{n}") for n, x in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    out = inner.join(F.broadcast(parts), "_part").withColumns({n: F.col(f"_i_{n}") + F.col(f"_o_{n}") for n in sums})
    return out.drop("_part", *[f"_i_{n}" for n in sums], *[f"_o_{n}" for n in sums])
