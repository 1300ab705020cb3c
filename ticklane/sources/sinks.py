"""Sinks: tables of a run, month-partitioned bucket maps, bars upserted in place, positions, models and their reports."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.sources.bars import union_dedup
from ticklane.sources.scratch import written


def save_tables(tables: dict[str, DataFrame | None], folder: str, kind: str = "parquet") -> list[str]:
    """Each table that is given, under its name; the paths written. kind: parquet, or csv with a header."""
    paths = []
    for name, df in tables.items():
        if df is not None:
            path = f"{folder.rstrip('/')}/{name}"
            writer = df.write.mode("overwrite")
            (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
            paths.append(path)
    return paths


def save_candidates(candidates: DataFrame, folder: str, day: str) -> str:
    return save_tables({f"candidates_{day}": candidates}, folder)[0]


def save_bucket_map(buckets: DataFrame, path: str) -> None:
    """A bucket map, partitioned by month (column ym)."""
    buckets.write.mode("overwrite").partitionBy("ym").parquet(path)


def _files(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions v1, v2 ... below path, in order."""
    make, files = _files(spark, path)
    files.mkdirs(make(path))
    return sorted(int(n[1:]) for n in (s.getPath().getName() for s in files.listStatus(make(path))) if n[:1] == "v" and n[1:].isdigit())


def put_version(spark: SparkSession, df: DataFrame, path: str, number: int) -> str:
    """Write df as a version. It is complete before it is there: its folder is renamed last, so a job that dies leaves the
    older ones valid; a version that is there already is put anew."""
    make, files = _files(spark, path)
    df.write.mode("overwrite").parquet(f"{path}/_tmp{number}")
    files.delete(make(f"{path}/v{number}"), True)
    files.rename(make(f"{path}/_tmp{number}"), make(f"{path}/v{number}"))
    return f"{path}/v{number}"


def save_run(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> str:
    """All tables of a run as the next version below folder; its path.  They are written beside it first and come to be there together, by
    one renaming: a run that dies leaves the version before, and the next one takes its place."""
    make, files = _files(spark, folder)
    number = max(version_numbers(spark, folder), default=0) + 1
    part = f"{folder}/_tmp{number}"
    files.delete(make(part), True)
    for name, df in tables.items():
        df.write.parquet(f"{part}/{name}")
    files.rename(make(part), make(f"{folder}/v{number}"))
    return f"{folder}/v{number}"


def load_run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest version; none without one."""
    numbers = version_numbers(spark, folder)
    if not numbers:
        return {}
    make, files = _files(spark, folder)
    path = f"{folder}/v{numbers[-1]}"
    return {n: spark.read.parquet(f"{path}/{n}") for n in sorted(s.getPath().getName() for s in files.listStatus(make(path)))}


def upsert_table(spark: SparkSession, path: str, fresh: DataFrame, keys: tuple[str, ...] = ("code", "date")) -> str:
    """Fresh rows merged into the newest version below path; the version written. Readers take the highest one."""
    numbers = version_numbers(spark, path)
    merged = union_dedup([spark.read.parquet(f"{path}/v{numbers[-1]}"), fresh], keys) if numbers else union_dedup([fresh], keys)
    return put_version(spark, merged, path, numbers[-1] + 1 if numbers else 1)


MONTH = "ym"


def _overwrite_months(spark: SparkSession, path: str) -> None:
    """Put what the journal holds in place of its months; the journal goes last, so a run that dies in between is done again."""
    make, files = _files(spark, path)
    journal = f"{path}/_journal"
    if files.exists(make(f"{journal}/_SUCCESS")):
        rows = spark.read.parquet(journal)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(f"{path}/data")
    files.delete(make(journal), True)


def upsert_months(spark: SparkSession, path: str, fresh: DataFrame, keys: tuple[str, ...] = ("code", "date"), month: str = "date") -> list[int | None]:
    """Fresh rows merged into a table by month; only the months that fresh rows have are read and written again.  Returns them.

    ``month``, a date among the keys, tells a row's month (yyyymm; null is one, too).  The merged months are written to a journal, and from
    there, whole, over the old ones, so whenever a run dies the next one, or read_months(), finds the table as before or as after it.
    A run that is made again changes nothing.  One writer at a time.
    """
    if month not in keys:
        raise ValueError(f"{month} must be one of the keys: a row would leave its old version in another month")
    _overwrite_months(spark, path)
    make, files = _files(spark, path)
    fresh = written(fresh.withColumn(MONTH, F.year(month) * 100 + F.month(month)), "fresh")
    months = [r[0] for r in fresh.select(MONTH).distinct().collect()]  # of a calendar's size
    if not months:
        return months
    frames = [fresh]
    if files.exists(make(f"{path}/data")):
        old = spark.read.option("mergeSchema", True).parquet(f"{path}/data")
        known = [m for m in months if m is not None]
        frames.insert(0, old.where(F.col(MONTH).isin(known) | (F.col(MONTH).isNull() if None in months else F.lit(False))))
    merged = union_dedup(frames, keys)
    merged.repartition(MONTH, *keys).write.mode("overwrite").partitionBy(MONTH).parquet(f"{path}/_journal")
    _overwrite_months(spark, path)
    return sorted(months, key=lambda m: m or 0)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert_months() keeps, without its month column."""
    _overwrite_months(spark, path)
    return spark.read.option("mergeSchema", True).parquet(f"{path}/data").drop(MONTH)


def save_walk_forward(metrics: DataFrame, folder: str, by: str = "variant") -> list[str]:
    """Walk-forward metrics and their means by variant, best first, as walk_forward_metrics and walk_forward_variant_summary."""
    numbers = [f.name for f in metrics.schema.fields if f.name not in (by, "window_id") and f.dataType.typeName() in ("double", "long", "integer")]
    means = metrics.groupBy(by).agg(*[F.avg(x).alias(x) for x in numbers]).orderBy(F.col("hit_rate").desc_nulls_last(), F.col("expectancy").desc_nulls_last(), by)
    return save_tables({"walk_forward_metrics": metrics, "walk_forward_variant_summary": means}, folder)


def save_positions(positions: DataFrame, path: str) -> None:
    positions.select("code", "status", "entry_date", "entry_price", "out_counter", "last_signal_date").write.mode("overwrite").parquet(path)


def load_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions with defaults: status OPEN, counter 0."""
    return spark.read.parquet(path).withColumn("code", F.col("code").cast("string")).fillna({"status": "OPEN", "out_counter": 0})


def save_model(model: PipelineModel, path: str, features: list[str], report: dict) -> None:
    """A model with its feature list and report beside it, as one-row JSON tables that any reader of the store can open."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps({"features": features, "report": report}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    return PipelineModel.load(f"{path}/model"), meta["features"], meta["report"]
