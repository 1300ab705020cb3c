"""What the operators of this subpackage share: scratch tables, seeded hashing, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane.sources.scratch import delete_path, scratch_path

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
ASCII_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Rows, and bytes of texts, that Python works on at a time; a single longer text is worked on alone.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: A key with over one in so many rows is hot; there are fewer hot keys than this.
HOT_SHARE = 500

_open: list[str] = []


class Scratch:
    """Tables written to the shared folder to cut lineage; each survives the loss of any executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = scratch_path(spark, label)
        self.count = 0
        _open.append(self.base)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df and return a scan of what was written."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._ticklane_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that cut() wrote and nothing reads any more."""
        path = getattr(df, "_ticklane_path", None)
        if path:
            delete_path(self.spark, path)

    def settle(self, make) -> DataFrame:
        """cut(make()), then delete every scratch folder that was opened to make it."""
        before = len(_open)
        out = self.cut(make())
        for path in _open[before:]:
            if path != self.base:
                delete_path(self.spark, path)
        del _open[before:]
        return out


def placed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[Column]]:
    """docs as a scan of files, and the columns _file (a hash of its file's path) and _line (its number there) that tell each row
    from any other, whatever ids it has.  What is no plain scan is written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = scratch.cut(docs)
    place = docs.metadataColumn("_metadata")
    return docs, [F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_line")]


def rows_at(docs: DataFrame, place: list[Column], chosen: DataFrame, how: str) -> DataFrame:
    """The rows of docs, all columns as they are, whose place is in chosen (left_semi) or is not (left_anti).

    Whole rows move at most once and are never sorted: the places are the hash table, broadcast only where Spark knows from
    their files that they are few.
    """
    small = chosen.select("_file", "_line")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *place)
    kept = rows.join(small.hint("shuffle_hash") if how == "left_semi" else small, ["_file", "_line"], how)
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], size: str, count: int) -> DataFrame:
    """rows joined, inner, with totals: one row a key, whose column ``size`` says how many of the ``count`` rows have the key.

    Both are tables that cut() wrote.  Hot keys, of which there are fewer than HOT_SHARE, are looked for first; if there are any,
    their totals are broadcast and their rows stay where they are, so no key gathers in a task.
    """
    hot = totals.where(F.col(size) * HOT_SHARE > count)
    if count < HOT_SHARE or hot.isEmpty():
        return rows.join(totals, keys)
    few = F.broadcast(hot)
    rest = rows.join(few.select(*keys), keys, "left_anti").join(totals, keys)
    return rows.join(few, keys).unionByName(rest)


#: Rows of a table of offsets that is broadcast; a larger one is joined.
FEW_ROWS = 1_000_000


def numbered(rows: DataFrame, group: str, order: list[str], scratch: Scratch, place: str, total: str) -> DataFrame:
    """rows with their place (from 0) in their group in the order of ``order``, and the group's total of rows.

    Rows are dealt to ranges and sorted there, and each range is given the counts of those before it, one row a range and group: no
    group meets in a task.  ``group`` must not be null, and ``order`` should tell rows apart, or equal ones share a range.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = scratch.cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seen", F.monotonically_increasing_id()))
    part = F.shiftright("_seen", 33).alias("_part")
    parts = dealt.groupBy(part, group).agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_n"))
    line = W.partitionBy(group).orderBy("_part")
    before = F.coalesce(F.sum("_n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.cut(parts.select("_part", group, (before - F.col("_first")).alias("_add"), F.sum("_n").over(W.partitionBy(group)).alias(total)))
    few = F.broadcast(parts) if parts.count() <= FEW_ROWS else parts
    found = dealt.withColumn("_part", part).join(few, ["_part", group])
    return found.withColumn(place, F.col("_seen") + F.col("_add")).drop("_part", "_seen", "_add")


def word_count(text: Column) -> Column:
    """Number of ASCII-white-space separated words; null has none. JVM only."""
    spaced = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.coalesce(
        F.when(spaced == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1),
        F.lit(0),
    ).cast("long")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def hash_share(doc_id: Column, seed: int) -> Column:
    """A seeded number in [0, 1) for each id, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 30)).cast("double") / float(1 << 30)


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of BATCH_ROWS rows and about BATCH_BYTES bytes of strings and lists at most; an empty one gives nothing."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(column.type):
            weight += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(weight)
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BATCH_BYTES, side="right"))
        high = min(max(high, low + 1), low + BATCH_ROWS, batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow whose function gets small batches: the session says how large those are that Spark sends (64 MB unless it is
    told otherwise), and slices() bounds what a function turns into Python objects at a time."""
    return df.mapInArrow(lambda batches: function(part for batch in batches for part in slices(batch)), schema)
