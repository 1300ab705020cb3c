"""Chart patterns: pullback to the 30-day mean, false breakdown, small up days, high tight flag; their forward statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.functions import indicators as ind
from ticklane.functions.base import EPS, ahead, b, full, lag, lead, sma, w, wr
from ticklane.functions.quantiles import exact_quantiles, few_rows
from ticklane.sources.scratch import written


def _events(df: DataFrame, name: str, hit, entry: int | None = 1) -> DataFrame:
    """Rows that hit, entered ``entry`` rows later (None: columns entry_date and entry_index are there)."""
    if entry is not None:
        df = df.withColumns({"entry_date": lead("date", entry), "entry_index": F.col("_i") + entry})
    return df.where(hit).select("code", "date", "entry_date", F.lit(name).alias("pattern"), F.col("_i").alias("bar_index"), "entry_index", F.lit(None).cast("int").alias("flag_n"))


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(w()) - 1)


def pullback_to_mean(df: DataFrame, touch: float = 0.005, hold: float = 0.003, quiet: float = 0.8, least: int = 35) -> DataFrame:
    """Close above, low at the 30-day mean on low volume; the next close holds it. df: add_pattern_basics."""
    df = numbered(df).withColumns({"_next": lead("close"), "_n": F.count(F.lit(1)).over(w().rowsBetween(-(1 << 30), 1 << 30))})
    hit = (F.col("close") > F.col("ma30")) & (F.col("low") <= F.col("ma30") * (1 + touch)) & (F.col("volume") <= F.col("vol_ma20") * quiet) & (F.col("_next") >= F.col("ma30") * (1 - hold)) & (F.col("_n") >= least)
    return _events(df, "PULLBACK_TO_MA30", b(hit))


def false_breakdown(df: DataFrame, lookback: int = 20, quiet: float = 0.8, days: int = 3) -> DataFrame:
    """Low under the lows of the rows before on low volume; the first close back above them within ``days`` rows is the entry."""
    before = w().rowsBetween(-lookback, -1)
    df = numbered(df).withColumn("_floor", F.when(F.count("low").over(before) == lookback, F.min("low").over(before)))
    step = F.lit(None).cast("int")
    for k in range(days, 0, -1):
        step = F.when(b(lead("close", k) > F.col("_floor")), k).otherwise(step)
    date = F.lit(None).cast("date")
    df = df.withColumn("_k", step)
    for k in range(1, days + 1):
        date = F.when(F.col("_k") == k, lead("date", k)).otherwise(date)
    df = df.withColumns({"entry_date": date, "entry_index": F.col("_i") + F.col("_k")})
    return _events(df, "FALSE_BREAKDOWN", b((F.col("low") < F.col("_floor")) & (F.col("volume") <= F.col("vol_ma20") * quiet)) & F.col("_k").isNotNull(), None)


def small_up_days(df: DataFrame, days: int = 4, small: float = 0.012, least: int = 3, slope: float = 1.0) -> DataFrame:
    """Several small gains with volume that does not fade; entered on the next row, whose date is null at the end."""
    df = numbered(df).withColumns({"_small": b((F.col("ret1") > 0) & (F.col("ret1") < small)).cast("int"), "_v5": sma("volume", 5)})
    df = df.withColumns({"_count": full("_small", days, F.sum("_small").over(wr(days))), "_v0": lag("_v5", days - 1)})
    return _events(df, "SMALL_UP_DAYS_GENTLE_VOL", b((F.col("_count") >= least) & (F.col("_v5") >= F.col("_v0") * slope)))


@dataclass(frozen=True)
class Flag:
    """Settings of the high tight flag."""

    day0_ret: float = 0.055
    day0_volume: float = 1.5
    day1_range: float = 0.02
    day1_body: float = 0.25
    base_days: int = 20
    base_range: float = 0.035
    base_volume_cv: float = 0.6
    shortest: int = 3
    longest: int = 10
    band: float = 0.01
    quiet: float = 0.8
    quiet_vs_day0: float = 0.7
    confirm_days: int = 10
    breakout: float = 0.01
    breakout_volume: float = 1.2
    hold: float = 0.003


def _flag_of(i: int, a: dict, s: Flag) -> tuple[int, int] | None:
    """(entry row, flag length) of a start at row i: the shortest flag that breaks out and holds."""
    n = len(a["close"])
    top, floor = max(a["high"][i : i + 2]), min(a["low"][i : i + 2])
    if not top > floor:
        return None
    for length in range(s.shortest, s.longest + 1):
        end = i + 1 + length
        if end >= n:
            return None
        inside = slice(i + 2, end + 1)
        volume, usual = a["volume"][inside].mean(), a["vol_ma20"][inside]
        usual = usual[~np.isnan(usual)]
        if a["high"][inside].max() > top * (1 + s.band) or a["low"][inside].min() < floor * (1 - s.band) or not len(usual):
            continue
        if volume > usual.mean() * s.quiet or volume > a["volume"][i] * s.quiet_vs_day0:
            continue
        for j in range(end + 1, min(n - 2, end + s.confirm_days) + 1):
            if a["close"][j] >= top * (1 + s.breakout) and a["volume"][j] >= a["vol_ma20"][j] * s.breakout_volume and a["close"][j + 1] >= top * (1 - s.hold):
                return j + 1, length
    return None


def high_tight_flag(df: DataFrame, s: Flag = Flag()) -> DataFrame:  # noqa: B008
    """A jump on volume out of a quiet base, a doji, a quiet flag inside their band and a breakout that holds.

    The start (base, jump and doji) is found by windows and is rare; only codes that have one are folded.
    """
    df = numbered(df).withColumn("_range", F.col("range") / F.col("close"))
    base = full("_range", s.base_days, F.avg("_range").over(wr(s.base_days))) <= s.base_range
    spread = full("volume", s.base_days, F.stddev_pop("volume").over(wr(s.base_days)) / (F.avg("volume").over(wr(s.base_days)) + EPS)) <= s.base_volume_cv
    doji = (lead("_range") <= s.day1_range) & (lead("body_ratio") <= s.day1_body)
    start = (F.col("ret1") >= s.day0_ret) & (F.col("volume") >= F.col("vol_ma20") * s.day0_volume) & base & spread & doji & (F.col("_i") > 0)
    df = df.withColumn("_start", b(start))
    rows = df.join(df.where("_start").select("code").distinct(), "code", "left_semi").select("code", "date", "high", "low", "close", "volume", "vol_ma20", "_start")

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable").reset_index(drop=True)
        a = {k: pdf[k].to_numpy(float) for k in ("high", "low", "close", "volume", "vol_ma20")}
        out = []
        for i in np.flatnonzero(pdf["_start"].to_numpy(bool)):
            hit = _flag_of(int(i), a, s)
            if hit:
                out.append((pdf["code"][i], pdf["date"][i], pdf["date"][hit[0]], "HIGH_TIGHT_FLAG", int(i), hit[0], hit[1]))
        return pd.DataFrame(out, columns=["code", "date", "entry_date", "pattern", "bar_index", "entry_index", "flag_n"])

    return rows.groupBy("code").applyInPandas(found, f"code {df.schema['code'].dataType.simpleString()}, date date, entry_date date, pattern string, bar_index int, entry_index int, flag_n int")


def scan(bars: DataFrame, flag: Flag = Flag()) -> DataFrame:  # noqa: B008
    """Events of all four patterns that can be entered: those at a code's end have no entry date and are left out."""
    df = ind.add_pattern_basics(bars)
    every = pullback_to_mean(df).unionByName(false_breakdown(df)).unionByName(small_up_days(df)).unionByName(high_tight_flag(df, flag))
    return every.where(F.col("entry_date").isNotNull())


def with_forward(events: DataFrame, bars: DataFrame, horizon: int = 30) -> DataFrame:
    """Events with entry close and the highest and lowest close of the next ``horizon`` rows; a short tail counts."""
    ahead_ = bars.select("code", F.col("date").alias("entry_date"), F.col("close").alias("entry_close"), F.max("close").over(ahead(horizon)).alias("fut_max_close"), F.min("close").over(ahead(horizon)).alias("fut_min_close"))
    df = events.join(ahead_, ["code", "entry_date"], "left")
    return df.withColumns({"fwd_max_ret": F.col("fut_max_close") / F.col("entry_close") - 1, "fwd_min_ret": F.col("fut_min_close") / F.col("entry_close") - 1})


def summary(events: DataFrame) -> DataFrame:
    """A row for each pattern: count, distribution of the best and worst forward close, hit rates."""
    rows = written(events.select("pattern", F.col("fwd_max_ret").alias("up"), F.col("fwd_min_ret").alias("dn")).where("up IS NOT NULL AND dn IS NOT NULL"), "forward")
    wanted = {"up": {"median_up": 0.5, "p75_up": 0.75, "p90_up": 0.9}, "dn": {"median_dn": 0.5, "p25_dn": 0.25, "p10_dn": 0.1}}
    found = exact_quantiles(rows, {x: list(q.values()) for x, q in wanted.items()}, "pattern")
    cuts = {n: x for x, q in wanted.items() for n in q}
    hit = lambda x: F.avg((F.col("up") >= x).cast("double"))
    sums = rows.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("count"), *[e(x).alias(f"{n}_{x}") for x in ("up", "dn") for n, e in (("mean", F.avg), ("min", F.min), ("max", F.max))],
        hit(0.05).alias("hit_up_5"), hit(0.10).alias("hit_up_10"), hit(0.20).alias("hit_up_20"))
    for x, q in wanted.items():
        sums = sums.join(F.broadcast(few_rows(events.sparkSession, found, x, list(q), "pattern", "string")), "pattern")  # a row a pattern
    return sums.select("pattern", "count", "mean_up", *[n for n in cuts if n.endswith("up")], "min_up", "max_up", "mean_dn", *[n for n in cuts if n.endswith("dn")], "min_dn", "max_dn", "hit_up_5", "hit_up_10", "hit_up_20")
