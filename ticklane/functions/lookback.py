"""Date filters that reach back far enough: what an operator reads around a row is declared, and only those dates are scanned.

The filter is a pair of date literals, so Parquet files and row groups outside them are skipped; results in the asked span are those of
the whole table, since every code has all the rows that its rows in the span look at.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that operators look back and ahead.  None: all of them (running sums, exponential means and the parabolic stop).
REACH: dict[str, tuple[int | None, int]] = {"rsi": (14, 0), "bollinger": (19, 0), "roc10": (10, 0), "rvol": (20, 0), "ret_mae": (0, 20), "dayn_windows": (6, 0), "window_vectors": (6, 5), "indicator_panel": (None, 0)}


def reach(*names: str) -> tuple[int | None, int]:
    """What several operators need together, each on the bars themselves."""
    back = [REACH[n][0] for n in names]
    return (None if None in back else max(back, default=0)), max((REACH[n][1] for n in names), default=0)


def padded(rows: DataFrame, first: date, last: date, back: int | None, ahead: int = 0, code: str = "code", day: str = "date") -> DataFrame:
    """rows of the dates that ``back`` rows before and ``ahead`` rows after the span first .. last need, for every code with rows in it.

    How far that is, is found in a scan of code and day alone: of each code with rows in the span, the day of its ``back``-th row
    before it and of its ``ahead``-th after it; the earliest and the latest of them bound the scan.  back None: no lower bound.
    """
    days = rows.select(F.col(code).alias("_c"), F.col(day).alias("_d"))
    lit = lambda x: F.lit(x).cast("date")
    low, high = lit(first), lit(last)
    inside = days.where(F.col("_d").between(low, high)).select("_c").distinct()
    near = lambda side, order, k: side.join(inside, "_c", "left_semi").withColumn("_k", F.row_number().over(W.partitionBy("_c").orderBy(order))).where(F.col("_k") <= k)
    start, end = first, last
    if back:
        start = near(days.where(F.col("_d") < low), F.desc("_d"), back).agg(F.min("_d")).first()[0] or first
    if ahead:
        end = near(days.where(F.col("_d") > high), F.asc("_d"), ahead).agg(F.max("_d")).first()[0] or last
    kept = rows.where(F.col(day) <= lit(end))
    return kept if back is None else kept.where(F.col(day) >= lit(start))


def within(rows: DataFrame, first: date, last: date, make, back: int | None, ahead: int = 0, day: str = "date") -> DataFrame:
    """make(rows) in first .. last, made from the dates that it needs."""
    found = make(padded(rows, first, last, back, ahead, day=day))
    return found.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
