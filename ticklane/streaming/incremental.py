"""Incremental updates: high-water marks, what to fetch, upserts where the newest row of a key wins, also as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.operators import labels
from ticklane.sources.bars import union_dedup
from ticklane.sources.scratch import scratch_path
from ticklane.sources.sinks import put_version, read_months, upsert_months, version_numbers


def high_water(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code").agg(F.max("date").alias("last_date"))


def fetch_plan(have: DataFrame, universe: DataFrame, default_start: str) -> DataFrame:
    """code, start_date: the day after the last one, for new codes the listing date or the default."""
    plan = universe.join(high_water(have), "code", "left")
    return plan.select("code", F.coalesce(F.date_add("last_date", 1), F.col("list_date"), F.lit(default_start).cast("date")).alias("start_date"))


def upsert(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """base with fresh rows added; of a key's rows the fresh one stays. Columns are united by name."""
    return union_dedup([base, fresh], tuple(keys))


def new_samples(samples: DataFrame, have: DataFrame) -> DataFrame:
    """Samples after the last one that is there, per code; all samples of codes that are not there yet."""
    found = samples.join(high_water(have), "code", "left")
    return found.where(F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))).drop("last_date")


def new_windows(bars: DataFrame, have: DataFrame, columns: list[str], length: int = 7, horizon: int = 5, threshold: float = 0.3) -> DataFrame:
    """Labelled windows of the last ``length`` rows that are new since ``have`` (code, date of each sample).

    Only the rows that new windows reach back to are read: the ``length`` - 1 calendar days before the last sample, as the
    windows of a known code are made of these rows alone.
    """
    last = high_water(have)
    rows = bars.join(last, "code", "left").where(F.col("last_date").isNull() | (F.col("date") >= F.date_sub("last_date", length - 1)))
    made = labels.dayn_windows(labels.label_updown(rows, horizon, threshold), columns, length)
    return made.where(F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))).drop("last_date")


class UpsertSink:
    """foreachBatch target for the table below ``base``; of a key's rows in one batch the one with the greatest ``order`` columns stays,
    then the one with the greatest other columns.

    With ``month``, a date among the keys, a batch reads and writes the months it touches and nothing else (upsert_months): a batch that is
    run again changes nothing.  Without, micro-batch n makes version n, whole before it is there, from the highest version below its own
    number.  Either way a restart from the stream's checkpoint goes on from the table on disk.
    """

    def __init__(self, spark: SparkSession, keys: list[str], base: str, order: list[str] | None = None, month: str | None = None):
        self.base, self.keys, self.order, self.month = base, keys, order or [], month

    def version(self, spark: SparkSession, below: int | None = None) -> str | None:
        """Path of the highest version, of those below a number."""
        numbers = [n for n in version_numbers(spark, self.base) if below is None or n < below]
        return f"{self.base}/v{max(numbers)}" if numbers else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in self.keys]
        newest = F.max(F.struct(*self.order, *[c for c in rest if c not in self.order])).alias("_row")
        batch = batch.groupBy(*self.keys).agg(newest).select(*[c if c in self.keys else F.col(f"_row.{c}").alias(c) for c in batch.columns]) if rest else batch.distinct()
        if self.month:
            upsert_months(spark, self.base, batch, tuple(self.keys), self.month)
            return
        before = self.version(spark, number)
        put_version(spark, batch if before is None else upsert(spark.read.parquet(before), batch, self.keys), self.base, number)


def stream_upsert(spark: SparkSession, rows: DataFrame, keys: tuple[str, ...] = ("code", "date")) -> DataFrame:
    """rows, arriving twice as files in reverse order, upserted as a stream into one table by month."""
    inbox = scratch_path(spark, "inbox")
    rows.where(F.dayofmonth("date") <= 15).write.parquet(inbox)
    rows.write.mode("append").parquet(inbox)
    sink = UpsertSink(spark, list(keys), scratch_path(spark, "upsert"), month="date")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(inbox)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_months(spark, sink.base).select(*rows.columns)
