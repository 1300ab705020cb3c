"""Rolling and recursive indicators of a bar panel (code, date, open, high, low, close, volume).

Each ``add_*`` takes a DataFrame and returns it with columns added.  All windows have the same specification (code, date), so
a chain of them shares one exchange and one sort.  Nulls are skipped as a pandas rolling window skips NaN: a window of n rows
gives null unless all n values are there.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklane.functions import folds as fd
from ticklane.functions.base import EPS, c, clip, div, full, lag, rolling_max, rolling_min, rolling_std, rolling_sum, sma, upto, w, wr


def add_ewm(df: DataFrame, source: str, name: str, alpha: float, least: int) -> DataFrame:
    """Exponential mean, y = (1 - a) y' + a x from the first value on, null until ``least`` values are there.

    Closed form: a prefix sum of c_k x_k (1 - a)^-k times (1 - a)^k, with c_0 = 1 and c_k = a, k counted from the first
    value.  To keep the powers within doubles, k starts over every e^600 of decay and the value that the row before left
    decays on.  Values must have no gaps after the first; with gaps use ewm_with_gaps.
    """
    q = 1.0 - alpha
    lap = max(2, int(600 / -math.log(q))) if 0 < q < 1 else 1 << 30
    x, k, s = f"_{name}_x", f"_{name}_k", f"_{name}_s"
    df = df.withColumn(k, F.count(c(source)).over(upto()) - 1)
    df = df.withColumn(x, F.when(c(source).isNotNull(), F.pmod(F.col(k), F.lit(lap))))
    weight = F.when(F.col(k) == 0, 1.0).otherwise(alpha)
    lap_of = F.when(F.col(x).isNotNull(), F.floor(F.col(k) / lap))
    df = df.withColumn(s, lap_of)
    inner = W.partitionBy("code", s).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    # one lap is all that nearly every series has: then the frame is the code's own
    local = F.sum(weight * c(source) * F.pow(F.lit(q), -F.col(x))).over(inner) * F.pow(F.lit(q), F.col(x))
    df = df.withColumn(name, local)
    before = W.partitionBy("code").orderBy(s).rangeBetween(-1, -1)
    carried = F.max_by(F.col(name), F.col(k)).over(before) * F.pow(F.lit(q), F.col(x) + 1)
    value = F.col(name) + F.coalesce(carried, F.lit(0.0))
    return df.withColumn(name, F.when((F.col(k) >= least - 1) & F.col(x).isNotNull(), value)).drop(x, k, s)


def add_ema(df: DataFrame, source: str, name: str, span: int) -> DataFrame:
    """EMA with a = 2 / (span + 1), null until span values are there."""
    return add_ewm(df, source, name, 2.0 / (span + 1), span)


def ewm_with_gaps(df: DataFrame, source: str, name: str, alpha: float, least: int) -> DataFrame:
    """The exponential mean where nulls may lie between values: a value's weight decays over the gap and the mean is renormalised.

    Folds each code's rows in its own task (Arrow batches of one code).
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", kind="stable")
        rows[name] = rows[source].ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        return rows

    return df.groupBy("code").applyInPandas(folded, schema)


def true_range() -> Column:
    """Greatest of the day's range and the distances from the close before; high - low on a first row."""
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(lag("close") - F.col("low")))


def add_true_range(df: DataFrame, name: str = "tr") -> DataFrame:
    return df.withColumn(name, true_range())


def add_atr(df: DataFrame, n: int = 14, name: str = "atr14") -> DataFrame:
    """Simple mean of the true range."""
    return add_true_range(df, "_tr").withColumn(name, sma("_tr", n)).drop("_tr")


def add_rsi(df: DataFrame, n: int = 14, name: str = "rsi14") -> DataFrame:
    """RSI of simple means; the first change counts as 0; null where nothing was lost."""
    step = F.coalesce(F.col("close") - lag("close"), F.lit(0.0))
    df = df.withColumns({"_up": F.greatest(step, F.lit(0.0)), "_down": F.greatest(-step, F.lit(0.0))})
    strength = div(sma("_up", n), sma("_down", n))
    return df.withColumn(name, clip(100 - 100 / (1 + strength), 0.0, 100.0)).drop("_up", "_down")


def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd_dif, macd_dea, macd_hist; the signal line counts from the first difference."""
    df = add_ema(add_ema(df, "close", "_fast", fast), "close", "_slow", slow)
    df = df.withColumn("macd_dif", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = add_ema(df, "macd_dif", "macd_dea", signal)
    return df.withColumn("macd_hist", F.col("macd_dif") - F.col("macd_dea"))


def add_bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """boll_mid, boll_up, boll_low, boll_bw (relative width)."""
    df = df.withColumns({"boll_mid": sma("close", n), "_sd": rolling_std("close", n)})
    df = df.withColumns({"boll_up": F.col("boll_mid") + k * F.col("_sd"), "boll_low": F.col("boll_mid") - k * F.col("_sd")})
    return df.withColumn("boll_bw", div(F.col("boll_up") - F.col("boll_low"), "boll_mid")).drop("_sd")


def add_obv(df: DataFrame) -> DataFrame:
    step = F.coalesce(F.col("volume") * F.signum(F.col("close") - lag("close")), F.lit(0.0))
    return df.withColumn("_step", step).withColumn("obv", F.sum("_step").over(upto())).drop("_step")


def add_cci(df: DataFrame, n: int = 20, name: str = "cci20") -> DataFrame:
    """The mean deviation takes each row's own mean, so 2n - 1 rows warm up."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    df = df.withColumn("_off", F.col("_tp") - sma("_tp", n)).withColumn("_abs", F.abs("_off"))
    return df.withColumn(name, div("_off", 0.015 * sma("_abs", n))).drop("_tp", "_off", "_abs")


def roc(x: str, n: int) -> Column:
    return div(c(x), lag(x, n)) - 1


def add_kdj(df: DataFrame, n: int = 9, m1: int = 3, m2: int = 3) -> DataFrame:
    low, high = rolling_min("low", n), rolling_max("high", n)
    df = df.withColumn("_rsv", div(F.col("close") - low, high - low) * 100)
    df = add_ewm(df, "_rsv", "kdj_k", 1 / m1, n)
    df = add_ewm(df, "kdj_k", "kdj_d", 1 / m2, n)
    return df.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d")).drop("_rsv")


def williams_r(n: int = 14) -> Column:
    """0 at the high, 100 at the low."""
    high, low = rolling_max("high", n), rolling_min("low", n)
    return div(high - F.col("close"), high - low) * 100


def add_dmi(df: DataFrame, n: int = 14) -> DataFrame:
    """plus_di14, minus_di14, adx14 of sums; moves count only if strictly greater than the opposite one."""
    rise = F.coalesce(F.greatest(F.col("high") - lag("high"), F.lit(0.0)), F.lit(0.0))
    fall = F.coalesce(F.greatest(lag("low") - F.col("low"), F.lit(0.0)), F.lit(0.0))
    df = df.withColumns({"_rise": rise, "_fall": fall, "_tr": true_range()})
    df = df.withColumns({
        "_plus": F.when(F.col("_rise") > F.col("_fall"), F.col("_rise")).otherwise(0.0),
        "_minus": F.when(F.col("_fall") > F.col("_rise"), F.col("_fall")).otherwise(0.0),
    })
    df = df.withColumns({"_total": rolling_sum("_tr", n), "_p": rolling_sum("_plus", n), "_m": rolling_sum("_minus", n)})
    df = df.withColumns({"plus_di14": div(100 * F.col("_p"), "_total"), "minus_di14": div(100 * F.col("_m"), "_total")})
    df = df.withColumn("_dx", div(100 * F.abs(F.col("plus_di14") - F.col("minus_di14")), F.col("plus_di14") + F.col("minus_di14")))
    return df.withColumn("adx14", sma("_dx", n)).drop("_rise", "_fall", "_tr", "_plus", "_minus", "_total", "_p", "_m", "_dx")


def stops(highs: list[float], lows: list[float], step: float = 0.02, most: float = 0.2) -> Iterator[float]:
    """Parabolic stop: a fold over a code's bars, starting long at its first low."""
    long, speed, extreme, stop, last = True, step, None, None, None
    for high, low in zip(highs, lows, strict=True):
        if stop is None:
            stop, extreme = low, low
        else:
            reach = stop + speed * (extreme - stop)
            reach = min(reach, last[1]) if long else max(reach, last[0])
            if low < reach if long else high > reach:
                stop, long, speed, extreme = extreme, not long, step, low if long else high
            else:
                stop, edge = reach, high if long else low
                if edge > extreme if long else edge < extreme:
                    extreme, speed = edge, min(speed + step, most)
        last = (high, low)
        yield stop


def add_psar(df: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """psar of each bar; codes are folded in their own tasks with a state of fixed size."""
    schema = T.StructType([*df.schema.fields, T.StructField("psar", T.DoubleType())])

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", kind="stable")
        rows["psar"] = list(stops(rows["high"].tolist(), rows["low"].tolist(), step, most))
        return rows

    return df.groupBy("code").applyInPandas(folded, schema)


def add_recursive(df: DataFrame, spans: tuple[int, ...] = (20, 50, 200), prefix: str = "ema", only: tuple[str, ...] | None = None) -> DataFrame:
    """Everything that depends on the whole past, in one fold per code: EMAs, MACD, KDJ and psar; only: those of them that are wanted.

    A panel needs psar's fold anyhow, and there pandas' exponential means take gaps and series of any length.  Rows leave the fold
    without a partitioning that Spark knows, so windows by code are best made before it.  Only KDJ and psar read high and low.
    """
    names = [*[f"{prefix}{n}" for n in spans], "macd_dif", "macd_dea", "macd_hist", "kdj_k", "kdj_d", "kdj_j", "psar"]
    names = [n for n in names if only is None or n in only]
    if not names:
        return df
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def folded(rows: pa.Table) -> pa.Table:
        rows = fd.without_nans(rows.sort_by("date"))
        high, low = (fd.values(rows, x) if x in rows.column_names else None for x in ("high", "low"))
        made = recursive(names, fd.values(rows, "close"), high, low, spans, prefix)
        return fd.with_figures(rows, {n: made[n] for n in names})

    return df.groupBy("code").applyInArrow(folded, schema)


def recursive(names: Collection[str], close: np.ndarray, high: np.ndarray | None, low: np.ndarray | None, spans: tuple[int, ...] = (20, 50, 200), prefix: str = "ema") -> dict[str, np.ndarray]:
    """Those of one code's recursive indicators that are named, and what they need."""
    made = {f"{prefix}{n}": fd.ema(close, n) for n in spans if f"{prefix}{n}" in names}
    if any(n.startswith("macd") for n in names):
        made["macd_dif"] = fd.ema(close, 12) - fd.ema(close, 26)
        made["macd_dea"] = fd.ema(made["macd_dif"], 9)
        made["macd_hist"] = made["macd_dif"] - made["macd_dea"]
    if any(n.startswith("kdj") for n in names):
        bottom, top = fd.lowest(low, 9), fd.highest(high, 9)
        made["kdj_k"] = fd.ewm(np.where(top > bottom, fd.div(close - bottom, top - bottom), np.nan) * 100, 1 / 3, 9)
        made["kdj_d"] = fd.ewm(made["kdj_k"], 1 / 3, 9)
        made["kdj_j"] = 3 * made["kdj_k"] - 2 * made["kdj_d"]
    if "psar" in names:
        made["psar"] = np.array(list(stops(high.tolist(), low.tolist())))
    return made


def add_mdd(df: DataFrame, n: int = 60, name: str = "mdd60") -> DataFrame:
    """Least close / rolling peak - 1 of the window."""
    return df.withColumn("_dd", div("close", rolling_max("close", n)) - 1).withColumn(name, rolling_min("_dd", n)).drop("_dd")


def gap_atr(atr: str = "atr14") -> Column:
    return F.abs(F.col("open") - lag("close")) / (c(atr) + EPS)


def tr_pct() -> Column:
    return true_range() / (F.abs(lag("close")) + EPS)


def pct_rank_max(x: str, n: int) -> Column:
    """Share of the window's values that are <= the last one."""
    values = F.collect_list(c(x)).over(wr(n))
    return full(x, n, F.size(F.filter(values, lambda v: v <= c(x))) / F.lit(float(n)))


def add_pct_ranks(df: DataFrame, n: int, least: int | None = None, **named: str) -> DataFrame:
    """df with, for each name=x, the average-rank percentile of the last value of x among the window's values, null where it is null or
    fewer than least are there.

    A window's values are a column until they are ranked: in one expression Spark would collect them anew wherever they are named.
    """
    df = df.withColumns({f"_{k}_values": F.collect_list(c(x)).over(wr(n)) for k, x in named.items()})
    ranks = {}
    for k, x in named.items():
        values = F.col(f"_{k}_values")
        # lower values and half of the equal ones: whole halves, so the sum is exact; native array functions, no lambda a value
        lower, others = F.array_position(F.sort_array(values), c(x)) - 1, F.size(F.array_remove(values, c(x)))
        rank = (lower + (F.size(values) - others) / F.lit(2.0) + 0.5) / F.size(values)
        ranks[k] = F.when((F.size(values) >= (least or n)) & c(x).isNotNull(), rank)
    return df.withColumns(ranks).drop(*(f"_{k}_values" for k in named))


def clv() -> Column:
    """Where the close lies in the day's range, -1..1; 0 without a range."""
    place = div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))
    return clip(F.coalesce(place, F.lit(0.0)), -1.0, 1.0)


def wick_ratios() -> dict[str, Column]:
    reach = F.col("high") - F.col("low")
    share = lambda x: clip(F.coalesce(div(x, reach), F.lit(0.0)), 0.0, 1.0)
    return {
        "upper_wick_ratio": share(F.col("high") - F.greatest("open", "close")),
        "lower_wick_ratio": share(F.least("open", "close") - F.col("low")),
        "body_ratio": share(F.abs(F.col("close") - F.col("open"))),
    }


def dist_to_high(n: int) -> Column:
    return div("close", rolling_max("close", n)) - 1


def breakout_atr(n: int = 20, atr: str = "atr14") -> Column:
    """Close above the highest high of the n rows before, in ATRs."""
    before = w().rowsBetween(-n, -1)
    top = F.when(F.count("high").over(before) == n, F.max("high").over(before))
    return (F.col("close") - top) / (c(atr) + EPS)


def rvol(n: int = 20) -> Column:
    return F.col("volume") / (sma("volume", n) + EPS)


def vol_zscore(n: int = 20) -> Column:
    return (F.col("volume") - sma("volume", n)) / (rolling_std("volume", n) + EPS)


def rav() -> Column:
    return F.col("volume") / (F.abs(F.col("high") - F.col("low")) + EPS)


def add_rav(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("rav", rav())
    return df.withColumn("rav_rel_20", F.col("rav") / (sma("rav", n) + EPS))


def vp_divergence(momentum: int = 5, short: int = 5, long: int = 20) -> Column:
    return roc("close", momentum) - (sma("volume", short) / (sma("volume", long) + EPS) - 1)


def add_atr_ratio(df: DataFrame, long: int = 60, atr: str = "atr14") -> DataFrame:
    return df.withColumn("atr_ratio", c(atr) / (sma(atr, long) + EPS))


def bandwidth() -> Column:
    """Bollinger width over the middle, safe at zero; needs boll_* columns."""
    return (F.col("boll_up") - F.col("boll_low")) / (F.col("boll_mid") + EPS)


def vol_slope(n: int = 5) -> Column:
    """Least-squares slope of the volume over the window's places."""
    return full("volume", n, F.regr_slope(F.col("volume"), F.col("_n").cast("double")).over(wr(n)))


def add_panel(df: DataFrame, recursive: tuple[str, ...] | None = None) -> DataFrame:
    """The 38 indicator columns that signals and factors read: folded_panel(), or, where recursive names none of the columns of
    add_recursive, the add_* functions in three window passes without Python.

    What depends on the bars alone is one pass over a code's rows, what depends on that a second, and adx14 a third; the
    functions one after the other would make a pass each.
    """
    named = [n for n in _RECURSIVE if recursive is None or n in recursive]
    if named:
        df = df.withColumns({"clv": clv()} | wick_ratios())
        return folded_panel(df, [*ROLLING, *named], df.columns)
    x, zero = F.col, F.lit(0.0)
    before = w().rowsBetween(-20, -1)
    df = df.withColumn("_tp", (x("high") + x("low") + x("close")) / 3.0)
    df = df.withColumns({
        "_pc": lag("close"), "_ph": lag("high"), "_pl": lag("low"), "boll_mid": sma("close", 20), "_sd": rolling_std("close", 20), "_tpm": sma("_tp", 20), "_top20": rolling_max("close", 20), "_top60": rolling_max("close", 60),
        "_before": F.when(F.count("high").over(before) == 20, F.max("high").over(before)), "rvol20": rvol(), "vol_z20": vol_zscore(), "wr14": williams_r()} | {f"roc{n}": roc("close", n) for n in (10, 20, 60)})
    step, rise, fall = F.coalesce(x("close") - x("_pc"), zero), F.coalesce(F.greatest(x("high") - x("_ph"), zero), zero), F.coalesce(F.greatest(x("_pl") - x("low"), zero), zero)
    df = df.withColumns({
        "_tr": F.greatest(x("high") - x("low"), F.abs(x("high") - x("_pc")), F.abs(x("_pc") - x("low"))), "_up": F.greatest(step, zero), "_down": F.greatest(-step, zero),
        "_step": F.coalesce(x("volume") * F.signum(x("close") - x("_pc")), zero), "_plus": F.when(rise > fall, rise).otherwise(0.0), "_minus": F.when(fall > rise, fall).otherwise(0.0),
        "_off": x("_tp") - x("_tpm"), "_dd": div("close", "_top60") - 1, "boll_up": x("boll_mid") + 2.0 * x("_sd"), "boll_low": x("boll_mid") - 2.0 * x("_sd")})
    df = df.withColumn("_abs", F.abs("_off"))
    df = df.withColumns({
        "atr14": sma("_tr", 14), "_gain": sma("_up", 14), "_loss": sma("_down", 14), "obv": F.sum("_step").over(upto()), "_total": rolling_sum("_tr", 14), "_p": rolling_sum("_plus", 14), "_m": rolling_sum("_minus", 14),
        "_dev": sma("_abs", 20), "mdd60": rolling_min("_dd", 60)})
    df = df.withColumns({
        "rsi14": clip(100 - 100 / (1 + div("_gain", "_loss")), 0.0, 100.0), "plus_di14": div(100 * x("_p"), "_total"), "minus_di14": div(100 * x("_m"), "_total"), "cci20": div("_off", 0.015 * x("_dev")),
        "boll_bw": div(x("boll_up") - x("boll_low"), "boll_mid"), "atr_pct": div("atr14", "close")})
    df = df.withColumn("_dx", div(100 * F.abs(x("plus_di14") - x("minus_di14")), x("plus_di14") + x("minus_di14")))
    df = df.withColumns({
        "adx14": sma("_dx", 14), "breakout20_atr": (x("close") - x("_before")) / (x("atr14") + EPS), "dist_high20": div("close", "_top20") - 1, "dist_high60": div("close", "_top60") - 1,
        "gap_atr14": F.abs(x("open") - x("_pc")) / (x("atr14") + EPS), "tr_pct": x("_tr") / (F.abs("_pc") + EPS), "clv": clv()} | wick_ratios())
    own = "_tp _pc _ph _pl _sd _tpm _top20 _top60 _before _tr _up _down _step _plus _minus _off _dd _abs _gain _loss _total _p _m _dev _dx"
    return df.drop(*own.split())


#: What folded_panel() makes beside the recursive indicators.
ROLLING = (
    "rsi14", "atr14", "atr_pct", "boll_mid", "boll_up", "boll_low", "boll_bw", "obv", "plus_di14", "minus_di14", "adx14", "cci20", "roc10", "roc20", "roc60", "wr14", "breakout20_atr", "dist_high20",
    "dist_high60", "rvol20", "vol_z20", "mdd60", "gap_atr14", "tr_pct",
)
_RECURSIVE = ("ema20", "ema50", "ema200", "macd_dif", "macd_dea", "macd_hist", "kdj_k", "kdj_d", "kdj_j", "psar")
NAMES = (*ROLLING, *_RECURSIVE)


def rolling(names: Collection[str], x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Those of one code's rolling indicators that are named, and what they need; x: the bars' columns."""
    high, low, close = x["high"], x["low"], x["close"]
    before = fd.lag(close)
    tr = fd.true_range(high, low, before)
    made = {"atr14": fd.mean(tr, 14)}
    made["atr_pct"] = fd.div(made["atr14"], close)
    if any(n.startswith("boll_") for n in names):
        made |= fd.bands(close)
    if any(n in names for n in ("plus_di14", "minus_di14", "adx14")):
        made |= fd.directions(high, low, tr)
    lazy = {
        "rsi14": lambda: fd.strength(close), "obv": lambda: fd.balance(close, x["volume"]), "cci20": lambda: fd.channel(high, low, close),
        "wr14": lambda: fd.div(fd.highest(high, 14) - close, fd.highest(high, 14) - fd.lowest(low, 14)) * 100,
        "breakout20_atr": lambda: fd.div(close - fd.lag(fd.highest(high, 20)), made["atr14"] + EPS), "mdd60": lambda: fd.lowest(fd.div(close, fd.highest(close, 60)) - 1, 60),
        "rvol20": lambda: fd.div(x["volume"], fd.mean(x["volume"], 20) + EPS), "vol_z20": lambda: fd.div(x["volume"] - fd.mean(x["volume"], 20), fd.deviation(x["volume"], 20) + EPS),
        "gap_atr14": lambda: fd.div(np.abs(x["open"] - before), made["atr14"] + EPS), "tr_pct": lambda: fd.div(tr, np.abs(before) + EPS),
    } | {f"roc{n}": lambda n=n: fd.div(close, fd.lag(close, n)) - 1 for n in (10, 20, 60)} | {f"dist_high{n}": lambda n=n: fd.div(close, fd.highest(close, n)) - 1 for n in (20, 60)}
    return made | {n: make() for n, make in lazy.items() if n in names}


def folded_panel(df: DataFrame, names: Collection[str], keep: Collection[str], more: dict[str, tuple] | None = None) -> DataFrame:
    """keep (columns of df) and the named indicators of add_panel(), all in one fold of a code's bars; more: name -> (how, column, rows
    [, least]) for what is made of them: "lag", "high" (is it the window's highest?), "rank" (its percentile in the window), "near_rank"
    (rounded first).

    A panel needs the fold of the recursive indicators anyhow.  A Spark window takes its aggregates anew over each row's frame, row by
    row; here a frame of n rows costs n sums of whole columns.  Rows go into the fold narrow, as bars, and come out with what is read.
    """
    more = more or {}
    kinds = {n: T.BooleanType() if how[0] == "high" else T.DoubleType() for n, how in more.items()}
    needed = {*names, *(how[1] for how in more.values() if how[1] in (*ROLLING, *_RECURSIVE))}
    reads = ["open", "high", "low", "close", "volume"]
    entering = list(dict.fromkeys(["code", "date", *keep, *reads, *(how[1] for how in more.values() if how[1] in df.columns)]))
    df = df.select(*entering)
    held, wanted = list(dict.fromkeys(["code", "date", *keep])), [n for n in names if n not in keep]
    schema = T.StructType([*(df.schema[n] for n in held), *(T.StructField(n, T.DoubleType()) for n in wanted), *(T.StructField(n, kind) for n, kind in kinds.items())])

    def folded(rows: pa.Table) -> pa.Table:
        rows = fd.without_nans(rows.sort_by("date"))
        x = {n: fd.values(rows, n) for n in reads}
        made = rolling(needed, x) | recursive(needed, x["close"], x["high"], x["low"])
        out = {n: made[n] for n in wanted}
        for n, (how, of, *least) in more.items():
            v = made[of] if of in made else fd.values(rows, of)
            if how == "lag":
                out[n] = fd.lag(v, *least)
            elif how == "high":
                top = fd.highest(v, *least)
                out[n] = pa.array(v >= top, mask=np.isnan(top) | np.isnan(v))
            else:
                out[n] = fd.place(fd.near(v) if how == "near_rank" else v, *least)
        return fd.with_figures(rows.select(held), out)

    return df.groupBy("code").applyInArrow(folded, schema)


def add_panel_v2(df: DataFrame, long_windows: bool = False) -> DataFrame:
    """The wide feature set: other spans of the same indicators, range-adjusted volume, divergence, ATR ratio; 252-row ranks by switch."""
    spans, reads = (10, 20, 60), ["open", "high", "low", "close", "volume"]
    same = {"roc_10": "roc10", "willr_14": "wr14", "gap_atr_14": "gap_atr14", "dist_to_high_20": "dist_high20", "breakout_atr_20_14": "breakout20_atr", "rvol_20": "rvol20"}
    plain = ("rsi14", "atr14", "boll_mid", "boll_up", "boll_low", "boll_bw", "obv", "plus_di14", "minus_di14", "adx14", "cci20", "mdd60", "tr_pct", "vol_z20")
    past = [*[f"ema_{n}" for n in spans], "macd_dif", "macd_dea", "macd_hist", "kdj_k", "kdj_d", "kdj_j", "psar"]

    def figures(rows: pa.Table) -> dict[str, np.ndarray]:
        x = {n: fd.values(rows, n) for n in reads}
        close, volume = x["close"], x["volume"]
        made = rolling({*plain, *same.values()}, x)
        rav, none = fd.div(volume, np.abs(x["high"] - x["low"]) + EPS), np.full(len(close), np.nan)
        bw2 = fd.div(made["boll_up"] - made["boll_low"], made["boll_mid"] + EPS)
        return {n: made[n] for n in plain} | {n: made[of] for n, of in same.items()} | {f"sma_{n}": fd.mean(close, n) for n in spans} | {
            "tr": fd.true_range(x["high"], x["low"], fd.lag(close)), "atr_pct_14": fd.div(made["atr14"], np.abs(close) + EPS), "rav": rav, "rav_rel_20": fd.div(rav, fd.mean(rav, 20) + EPS),
            "atr_ratio": fd.div(made["atr14"], fd.mean(made["atr14"], 60) + EPS), "boll_bw2": bw2,
            "vp_div_5_5_20": fd.div(close, fd.lag(close, 5)) - 1 - (fd.div(fd.mean(volume, 5), fd.mean(volume, 20) + EPS) - 1),
            "tr_pctile_252": fd.share(made["tr_pct"], 252) if long_windows else none, "boll_bw_q252": fd.share(bw2, 252) if long_windows else none,
        } | recursive(past, close, x["high"], x["low"], spans, "ema_")

    names = [*plain, *same, *(f"sma_{n}" for n in spans), "tr", "atr_pct_14", "rav", "rav_rel_20", "atr_ratio", "boll_bw2", "vp_div_5_5_20", "tr_pctile_252", "boll_bw_q252", *past]
    df = df.withColumns({"clv": clv()} | wick_ratios())
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def folded(rows: pa.Table) -> pa.Table:
        rows = fd.without_nans(rows.sort_by("date"))
        made = figures(rows)
        return fd.with_figures(rows, {n: made[n] for n in names})

    return df.groupBy("code").applyInArrow(folded, schema)


def add_pattern_basics(df: DataFrame) -> DataFrame:
    """What the chart patterns read: ret1, volume and price means, extremes, range, body."""
    df = add_atr(df)
    df = df.withColumns({
        "ret1": roc("close", 1), "vol_ma5": sma("volume", 5), "vol_ma20": sma("volume", 20), "ma20": sma("close", 20), "ma30": sma("close", 30),
        "hh20": rolling_max("close", 20), "ll20": rolling_min("close", 20), "range": F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), "body": F.abs(F.col("close") - F.col("open")),
    })
    return df.withColumn("body_ratio", clip(F.col("body") / (F.col("range") + EPS), 0.0, 10.0))
