"""Queries of the indicator operators and of the bar sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.functions import indicators as ind
from ticklane.functions.base import c, div, sma, w
from ticklane.plans import oracle as o
from ticklane.sources import bars as src

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PANEL = [
    "ema20", "ema50", "ema200", "macd_dif", "macd_dea", "macd_hist", "rsi14", "atr14", "atr_pct", "boll_mid", "boll_up", "boll_low", "boll_bw", "obv",
    "plus_di14", "minus_di14", "adx14", "cci20", "roc10", "roc20", "roc60", "kdj_k", "kdj_d", "kdj_j", "wr14", "psar", "breakout20_atr", "dist_high20",
    "dist_high60", "rvol20", "vol_z20", "mdd60", "gap_atr14", "tr_pct", "clv", "upper_wick_ratio", "lower_wick_ratio", "body_ratio",
]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars_from_lineitem(spark, sf_dir)


def rounded(df: DataFrame, columns: list[str], plain: tuple[str, ...] = ("code", "date"), places: int = 6) -> DataFrame:
    return df.select(*plain, *[F.round(F.col(x), places).alias(x) for x in columns])


def register(name: str, make, sql: str | None) -> None:
    """make(spark, sf_dir) -> DataFrame."""
    QUERIES[name] = make
    if sql:
        ORACLE[name] = sql


def indicator(name: str, add, columns: list[str], chain: o.Chain) -> None:
    register(name, lambda s, d: rounded(add(bars(s, d)), columns), chain.show(columns))


def with_(**made):
    """A projection of columns that are made when the query is planned."""
    return lambda df: df.withColumns({k: f() for k, f in made.items()})


start = o.Chain()
register("bars", bars, start.end("SELECT code, date, open, high, low, close, preclose, volume, amount, turnover, pct_chg, pb_mrq, ps_ttm FROM {t}"))
indicator("ema", lambda df: ind.add_ema(ind.add_ema(df, "close", "ema20", 20), "close", "ema200", 200), ["ema20", "ema200"],
          o.ewm(o.ewm(start, "close", "ema20", "(2.0/21)::DOUBLE", 20), "close", "ema200", "(2.0/201)::DOUBLE", 200))
indicator("sma", with_(sma20=lambda: sma("close", 20), sma50=lambda: sma("close", 50)), ["sma20", "sma50"], start.add(sma20=o.sma("close", 20), sma50=o.sma("close", 50)))
indicator("true_range", ind.add_true_range, ["tr"], start.add(tr=o.TR))
indicator("atr", ind.add_atr, ["atr14"], o.add_atr(start))
indicator("rsi", ind.add_rsi, ["rsi14"], o.add_rsi(start))
indicator("macd", ind.add_macd, ["macd_dif", "macd_dea", "macd_hist"], o.add_macd(start))
indicator("bollinger", ind.add_bollinger, ["boll_mid", "boll_up", "boll_low", "boll_bw"], o.add_boll(start))
indicator("obv", ind.add_obv, ["obv"], o.add_obv(start))
indicator("cci", ind.add_cci, ["cci20"], o.add_cci(start))
indicator("roc", with_(roc10=lambda: ind.roc("close", 10), roc60=lambda: ind.roc("close", 60)), ["roc10", "roc60"], start.add(roc10=o.roc("close", 10), roc60=o.roc("close", 60)))
indicator("kdj", ind.add_kdj, ["kdj_k", "kdj_d", "kdj_j"], o.add_kdj(start))
indicator("williams_r", with_(wr14=ind.williams_r), ["wr14"], start.add(wr14=o.WR14))
indicator("dmi_adx", ind.add_dmi, ["plus_di14", "minus_di14", "adx14"], o.add_dmi(start))
indicator("psar", ind.add_psar, ["psar"], o.psar(start))
indicator("rolling_mdd", ind.add_mdd, ["mdd60"], o.add_mdd(start))
indicator("gap_atr", lambda df: with_(gap_atr14=ind.gap_atr)(ind.add_atr(df)), ["gap_atr14"], o.add_atr(start).add(gap_atr14=o.GAP))
indicator("tr_pct", with_(tr_pct=ind.tr_pct), ["tr_pct"], start.add(tr_pct=o.TRPCT))
indicator("rolling_pct_rank", with_(close_rank=lambda: ind.pct_rank_max("close", 60)), ["close_rank"], start.add(close_rank=o.pct_max("close", 60)))
indicator("tr_pctile", lambda df: with_(tr_pctile=lambda: ind.pct_rank_max("tr_pct", 120))(with_(tr_pct=ind.tr_pct)(df)), ["tr_pctile"],
          start.add(tr_pct=o.TRPCT).add(tr_pctile=o.pct_max("tr_pct", 120)))
indicator("clv", with_(clv=ind.clv), ["clv"], start.add(clv=o.CLV))
indicator("wick_ratios", lambda df: df.withColumns(ind.wick_ratios()), list(o.WICKS), start.add(**o.WICKS))
indicator("dist_to_high", with_(dist_high20=lambda: ind.dist_to_high(20), dist_high60=lambda: ind.dist_to_high(60)), ["dist_high20", "dist_high60"], start.add(dist_high20=o.DIST[20], dist_high60=o.DIST[60]))
indicator("breakout_atr", lambda df: with_(breakout20_atr=ind.breakout_atr)(ind.add_atr(df)), ["breakout20_atr"], o.add_atr(start).add(breakout20_atr=o.BREAKOUT))
indicator("rvol", with_(rvol20=ind.rvol), ["rvol20"], start.add(rvol20=o.RVOL))
indicator("vol_zscore", with_(vol_z20=ind.vol_zscore), ["vol_z20"], start.add(vol_z20=o.VOLZ))
_rav = start.add(rav="volume / (abs(high - low) + 1e-12)").add(rav_rel_20=f"rav / (({o.sma('rav', 20)}) + 1e-12)")
indicator("rav", ind.add_rav, ["rav_rel_20"], _rav)
indicator("vp_div", with_(vp_div_5_5_20=ind.vp_divergence), ["vp_div_5_5_20"], start.add(vp_div_5_5_20=o.VPDIV))
_ratio = o.add_atr(start).add(atr_ratio=f"atr14 / (({o.sma('atr14', 60)}) + 1e-12)")
indicator("atr_ratio", lambda df: ind.add_atr_ratio(ind.add_atr(df)), ["atr_ratio"], _ratio)
indicator("boll_bw_q", lambda df: with_(boll_bw_q=lambda: ind.pct_rank_max("boll_bw2", 120))(with_(boll_bw2=lambda: F.round(ind.bandwidth(), 9))(ind.add_bollinger(df))), ["boll_bw_q"],
          o.add_boll(start).add(boll_bw2="round((boll_up - boll_low) / (boll_mid + 1e-12), 9)").add(boll_bw_q=o.pct_max("boll_bw2", 120)))
indicator(
    "vol_slope",
    lambda df: df.withColumn("_n", F.row_number().over(w())).withColumns({"vol_slope": ind.vol_slope(), "vol_change": ind.roc("volume", 1), "vol_ratio": div(sma("volume", 5), sma("volume", 20))}),
    ["vol_slope", "vol_change", "vol_ratio"],
    start.add(vol_slope=f"CASE WHEN rn >= 5 THEN ((-2) * {o.lag('volume', 4)} - {o.lag('volume', 3)} + {o.lag('volume', 1)} + 2 * volume) / 10.0 END", vol_change=o.roc("volume", 1), vol_ratio=o.div(o.sma("volume", 5), f"({o.sma('volume', 20)})")),
)
indicator("rolling_avg_rank", lambda df: ind.add_pct_ranks(df, 120, 20, pb_rolling_rank="pb_mrq", ps_rolling_rank="ps_ttm"), ["pb_rolling_rank", "ps_rolling_rank"],
          start.add(pb_rolling_rank=o.pct_avg("pb_mrq", 120, 20), ps_rolling_rank=o.pct_avg("ps_ttm", 120, 20)))
indicator("indicator_panel", ind.add_panel, PANEL, o.panel())

V2 = [
    "ema_10", "ema_20", "ema_60", "sma_10", "sma_20", "sma_60", "tr", "atr14", "atr_pct_14", "rsi14", "macd_dif", "macd_dea", "macd_hist", "boll_mid", "boll_up", "boll_low",
    "boll_bw", "obv", "cci20", "roc_10", "kdj_k", "kdj_d", "kdj_j", "willr_14", "plus_di14", "minus_di14", "adx14", "psar", "mdd60", "gap_atr_14", "tr_pct", "tr_pctile_252", "clv",
    "upper_wick_ratio", "lower_wick_ratio", "body_ratio", "dist_to_high_20", "breakout_atr_20_14", "rvol_20", "vol_z20", "rav_rel_20", "vp_div_5_5_20", "atr_ratio", "boll_bw2", "boll_bw_q252",
]
_v2 = start
for _n in (10, 20, 60):
    _v2 = o.ewm(_v2, "close", f"ema_{_n}", f"(2.0/{_n + 1})::DOUBLE", _n)
_v2 = o.add_atr(_v2).add(tr="_tr", atr_pct_14="atr14 / (abs(close) + 1e-12)", **{f"sma_{n}": o.sma("close", n) for n in (10, 20, 60)})
_v2 = o.add_mdd(o.add_cci(o.add_dmi(o.add_obv(o.add_boll(o.add_rsi(o.psar(o.add_kdj(o.add_macd(_v2)))))))))
_v2 = _v2.add(rav="volume / (abs(high - low) + 1e-12)", roc_10=o.roc("close", 10), willr_14=o.WR14, gap_atr_14=o.GAP, tr_pct=o.TRPCT, clv=o.CLV, dist_to_high_20=o.DIST[20], breakout_atr_20_14=o.BREAKOUT, rvol_20=o.RVOL, vol_z20=o.VOLZ, vp_div_5_5_20=o.VPDIV, boll_bw2="(boll_up - boll_low) / (boll_mid + 1e-12)", **o.WICKS)
_v2 = _v2.add(rav_rel_20=f"rav / (({o.sma('rav', 20)}) + 1e-12)", atr_ratio=f"atr14 / (({o.sma('atr14', 60)}) + 1e-12)", tr_pctile_252="CAST(NULL AS DOUBLE)", boll_bw_q252="CAST(NULL AS DOUBLE)")
indicator("indicator_panel_v2", ind.add_panel_v2, V2, _v2)
BASICS = ["ret1", "vol_ma5", "vol_ma20", "ma20", "ma30", "hh20", "ll20", "atr14", "range", "body", "body_ratio"]
_basics = o.add_atr(start).add(ret1=o.roc("close", 1), vol_ma5=o.sma("volume", 5), vol_ma20=o.sma("volume", 20), ma20=o.sma("close", 20), ma30=o.sma("close", 30), hh20=o.top("close", 20), ll20=o.bottom("close", 20), range="nullif(high - low, 0)", body="abs(close - open)")
_basics = _basics.add(body_ratio=o.clip("body / (range + 1e-12)", 0.0, 10.0))
register("pattern_indicators", lambda s, d: rounded(ind.add_pattern_basics(bars(s, d)), BASICS), _basics.end("SELECT code, date, " + ", ".join(f'round("{x}", 6) AS "{x}"' for x in BASICS) + " FROM {t}"))


# ---- sources -------------------------------------------------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, list[str]]:
    """The bars as CSV files with the headers of bar files, in the session's scratch folder."""
    from ticklane.sources.scratch import scratch_path

    names = {v: k for k, v in src.HEADERS.items()}
    df = bars(spark, sf_dir)
    df = df.select(*[F.col(x).alias(names.get(x, x)) for x in df.columns])
    path = scratch_path(spark, name)
    df.write.option("header", True).csv(path)
    return path, df.columns


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, columns = _written(spark, sf_dir, "scan_csv")
    df = src.normalize_cols(src.scan_csv(spark, path, columns))
    return df.select(F.col("code").cast("long").alias("code"), "date", *src.NUMBERS)


register("scan_csv", scan_csv, ORACLE["bars"])


def normalize_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bars(spark, sf_dir).select("code", F.col("date").cast("string").alias("日期"), F.col("close").cast("string").alias("收盘"), F.when(c("code") % 7 == 0, "-").otherwise(F.col("volume").cast("string")).alias("成交量"))
    return src.normalize_cols(raw).select("code", "date", "close", "volume", "open")


register("normalize_cols", normalize_cols, start.end("SELECT code, date, close, CASE WHEN code % 7 = 0 THEN NULL ELSE volume END AS volume, CAST(NULL AS DOUBLE) AS open FROM {t}"))


def union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir).select("code", "date", "close")
    late = df.where(F.dayofmonth("date") > 20).withColumn("close", F.col("close") + 1).withColumn("note", F.lit("late"))
    return src.union_dedup([df, late])


register("union_dedup", union_dedup, start.end("SELECT code, date, CASE WHEN day(date) > 20 THEN close + 1 ELSE close END AS close, CASE WHEN day(date) > 20 THEN 'late' END AS note FROM {t}"))
register("auto_columns", lambda s, d: src.auto_columns(bars(s, d).select(F.col("code").alias("Ticker"), F.col("date").alias("Trade_Date"), F.col("open").alias("开盘价"), F.col("high").alias("High"), F.col("low").alias("LOW"), F.col("close").alias("收盘"), F.col("volume").alias("Vol"))),
         start.end("SELECT code, date, open, high, low, close, volume FROM {t}"))
register("norm_code", lambda s, d: bars(s, d).select("code").distinct().select("code", src.norm_code(F.concat(F.lit(" "), F.col("code").cast("string"), F.lit(".sh "))).alias("norm")), start.end("SELECT DISTINCT code, lpad(CAST(code AS VARCHAR), 6, '0') AS norm FROM {t}"))
register("exchange_symbol", lambda s, d: bars(s, d).select("code").distinct().select("code", src.exchange_symbol(F.concat(F.lit("x."), (F.col("code") * 9973).cast("string"))).alias("symbol")),
         start.end("SELECT code, CASE WHEN n[1] IN ('5','6','9') THEN 'sh.' WHEN n[1] IN ('4','8') THEN 'bj.' ELSE 'sz.' END || n AS symbol FROM (SELECT DISTINCT code, CASE WHEN length(CAST(code*9973 AS VARCHAR)) < 6 THEN lpad(CAST(code*9973 AS VARCHAR), 6, '0') ELSE CAST(code*9973 AS VARCHAR) END AS n FROM {t})"))
register("scan_clean_ohlcv", lambda s, d: src.clean_ohlcv(bars(s, d).withColumn("volume", F.when(F.col("code") % 7 == 0, "n/a").otherwise(F.col("volume").cast("string")))),
         start.end("SELECT CAST(code AS VARCHAR) AS code, date, open, high, low, close, volume FROM {t} WHERE code % 7 <> 0"))
