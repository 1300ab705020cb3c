"""Queries of signals, scores, market state, factors, ranks and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane import config as cf
from ticklane.functions import indicators as ind
from ticklane.functions.base import wd
from ticklane.operators import buckets
from ticklane.operators import signals as sg
from ticklane.plans import oracle as o
from ticklane.plans.indicator_queries import bars, rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE[name] = sql


# ---- the oracle's panel: valuation, market state, signals, scores ----------------------------------------------------


def sql_cs_rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"


def sql_valuation(chain: o.Chain) -> o.Chain:
    chain = chain.add(
        pb_log="CASE WHEN pb_mrq > 0 THEN ln(1 + pb_mrq) END", ps_log="CASE WHEN ps_ttm > 0 THEN ln(1 + ps_ttm) END",
        pb_rolling_rank=o.pct_avg("pb_mrq", 120, 20), ps_rolling_rank=o.pct_avg("ps_ttm", 120, 20), pb_cs_rank=sql_cs_rank("pb_mrq"), ps_cs_rank=sql_cs_rank("ps_ttm"))
    return chain.add(value_score="(1 - pb_cs_rank) * 0.5 + (1 - ps_cs_rank) * 0.5")


def sql_state(chain: o.Chain, bucket: str = "0") -> o.Chain:
    """Table state beside the chain."""
    chain = chain.table(f"SELECT date, {bucket} AS bucket_id, median(adx14) AS idx_adx14, median(boll_bw) AS idx_bw FROM {{t}} GROUP BY 1, 2", "state0")
    line = "OVER (PARTITION BY bucket_id ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"
    below = f"len(list_filter(list(x) {line}, lambda v: v < x))"
    same = f"len(list_filter(list(x) {line}, lambda v: v = x))"
    chain = chain.table(f"SELECT *, CASE WHEN count(x) {line} = 120 THEN ({below} + ({same} + 1) / 2.0) / count(x) {line} END AS idx_bw_q FROM (SELECT *, round(idx_bw, 9) AS x FROM state0)", "state1")
    return chain.table("SELECT date, bucket_id, idx_adx14, idx_bw, idx_bw_q, CASE WHEN idx_adx14 >= 25 AND idx_bw_q > 0.3 THEN 'trend_ok' WHEN idx_adx14 < 20 AND idx_bw_q <= 0.3 THEN 'range_bias' ELSE 'neutral' END AS market_state_index FROM state1", "state")


OBV_HIGH = f"obv >= {o.top('obv', 20)}"
SIGNALS = {
    "s1_entry": f"CASE WHEN ema50 > ema200 AND adx14 >= 25 AND abs(close - ema20) <= 0.8 * atr14 AND macd_hist > 0 AND rsi14 >= 45 AND (obv - {o.lag('obv', 20)} > 0 OR {OBV_HIGH}) THEN 1 ELSE 0 END",
    "s1_stop": "close - 1.8 * atr14", "s1_pos": "least(0.005 / nullif(1.8 * atr_pct, 0), CASE WHEN atr_pct <> 0 THEN 0.2 END)",
    "s2_entry": f"CASE WHEN bw_q <= 0.3 AND close > boll_up AND adx14 > {o.lag('adx14')} AND {OBV_HIGH} THEN 1 ELSE 0 END",
    "s2_stop": "boll_mid - 1.0 * atr14", "s2_pos": "least(0.005 / nullif(1.0 * atr_pct, 0), CASE WHEN atr_pct <> 0 THEN 0.2 END)",
    "s3_long_entry": "CASE WHEN rsi14 <= 35 AND (coalesce(close <= boll_low, false) OR coalesce(close <= ema20 - 1.0 * atr14, false)) THEN 1 ELSE 0 END",
    "s3_stop": "close - 1.2 * atr14", "s3_pos": "least(0.005 / nullif(1.2 * atr_pct, 0), CASE WHEN atr_pct <> 0 THEN 0.2 END)",
    "s4_pyramid": f"CASE WHEN plus_di14 > minus_di14 AND adx14 > {o.lag('adx14')} AND (coalesce(cci20 > 100, false) OR coalesce(roc10 > 0, false)) AND {OBV_HIGH} THEN 1 ELSE 0 END",
    "market_state_stock": "CASE WHEN adx14 >= 25 THEN 'trend' WHEN adx14 < 20 THEN 'range' WHEN adx14 IS NOT NULL THEN 'neutral' END",
}


def sql_raw_signals(chain: o.Chain) -> o.Chain:
    chain = chain.add(_bw="round(boll_bw, 9)").add(bw_q=o.pct_avg("_bw", 120))
    return chain.add(**SIGNALS)


def sql_signals() -> o.Chain:
    chain = sql_state(sql_raw_signals(sql_valuation(o.panel())))
    chain = chain.table("SELECT p.*, s.market_state_index FROM {t} p LEFT JOIN state s USING (date)")
    ok, trend, ranging = "market_state_index IN ('trend_ok', 'neutral')", "market_state_stock = 'trend'", "market_state_stock = 'range'"
    gates = {"s1_entry": f"{ok} AND {trend}", "s2_entry": ok, "s3_long_entry": ranging, "s4_pyramid": f"{ok} AND {trend}"}
    said = ", ".join(f"CASE WHEN {gate} THEN {k} ELSE 0 END AS {k}" for k, gate in gates.items())
    return chain.table(f"SELECT * REPLACE ({said}) FROM {{t}}")


TECHNICAL = "least(100.0, (coalesce(least(greatest(adx14, 0), 100), 0) + 20 * s2_entry + 10 * s1_entry + 8 * s3_long_entry) / 2)"
VALUE100 = "coalesce(CASE WHEN value_score IS NOT NULL THEN least(greatest(value_score, 0), 1) * 100 END, (coalesce(1 - pb_cs_rank, 0) + coalesce(1 - ps_cs_rank, 0)) / nullif((pb_cs_rank IS NOT NULL)::INT + (ps_cs_rank IS NOT NULL)::INT, 0) * 100)"


def sql_scored() -> o.Chain:
    chain = sql_signals().add(technical_score=TECHNICAL, value_score_100=VALUE100)
    return chain.add(candidate_score="(technical_score * 0.7 + coalesce(value_score_100, 0) * 0.3) / (0.7 + CASE WHEN value_score_100 IS NOT NULL THEN 0.3 ELSE 0 END)")


RAW = {
    "trend_raw": "0.35 * coalesce(ema20 > ema50, false)::INT + 0.35 * coalesce(ema50 > ema200, false)::INT + 0.20 * CASE WHEN adx14 IS NOT NULL THEN least(greatest(adx14 / 50, 0), 1) END + 0.10 * CASE WHEN plus_di14 IS NOT NULL AND minus_di14 IS NOT NULL THEN least(greatest((plus_di14 - minus_di14) / 50, -1), 1) END",
    "momentum_raw": "0.35 * coalesce(roc10, 0) + 0.35 * coalesce(macd_hist, 0) + 0.15 * coalesce(cci20, 0) + 0.15 * coalesce(close / nullif(ema20, 0) - 1, 0)",
    "medium_term_raw": "0.30 * coalesce(roc20, 0) + 0.30 * coalesce(roc60, 0) + 0.20 * coalesce(CASE WHEN breakout20_atr IS NOT NULL THEN least(greatest(breakout20_atr, -3), 3) END, 0) + 0.10 * coalesce(dist_high60, -0.10) + 0.10 * (1 + coalesce(mdd60, -0.30))",
    "signal_raw": "0e0 + s2_entry + 0.8 * s1_entry + 0.6 * s3_long_entry + 0.4 * s4_pyramid + CASE WHEN market_state_index = 'trend_ok' THEN 0.2 ELSE 0 END",
    "quality_raw": "0.30 * coalesce(clv, 0) + 0.20 * coalesce(body_ratio, 0) + 0.10 * coalesce(lower_wick_ratio, 0) + 0.15 * coalesce(CASE WHEN rvol20 IS NOT NULL THEN least(greatest(rvol20, 0), 4) END, 1) - 0.15 * coalesce(CASE WHEN gap_atr14 IS NOT NULL THEN least(greatest(gap_atr14, 0), 3) END, 0) - 0.10 * coalesce(CASE WHEN tr_pct IS NOT NULL THEN least(greatest(tr_pct, 0), 0.2) END, 0)",
    "value_factor_raw": "value_score", "risk_raw": "-atr_pct", "liquidity_raw": "turnover",
}
FACTORS = list(cf.FACTORS)


def sql_factors() -> o.Chain:
    chain = sql_scored().add(**RAW).add(**{f"_{f}": f"round({f}_raw, 9)" for f in FACTORS})
    chain = chain.add(**{f"{f}_score": f"coalesce({sql_cs_rank('_' + f)}, 0.5) * 100" for f in FACTORS})
    mean = lambda ws: "(" + " + ".join(f"{f}_score * {x}" for f, x in zip(FACTORS, ws, strict=True)) + f") / {sum(ws)}"
    return chain.add(multifactor_score=mean(cf.COMPOSITE), **{f"profile_score_{p}": mean(ws) for p, ws in cf.PROFILES.items()})


RISING = "coalesce(ema50 > ema200 AND close > ema20, false)"
NEAR = f"(s1_entry = 1 OR ({RISING} AND coalesce(dist_high20 > -0.08 AND dist_high20 < -0.01, false)))"
STRONG = f"({RISING} AND coalesce(clv > 0 AND body_ratio > 0.35, false))"
MASKS = {
    "breakout": "(s2_entry = 1 OR coalesce(breakout20_atr > 0, false) OR coalesce(close > boll_up, false))", "pullback": NEAR,
    "mid_momo": f"({RISING} AND coalesce(roc20 > 0 AND roc60 > 0, false))", "quality_trend": STRONG,
    "value_trend": f"({RISING} AND coalesce(value_score > 0.55, false))", "pullback_quality_combo": f"({STRONG} OR {NEAR})",
}
STRATEGY = "CASE WHEN s2_entry = 1 THEN 'S2' WHEN s1_entry = 1 THEN 'S1' WHEN s3_long_entry = 1 THEN 'S3' ELSE 'MF' END"
SIGNAL = "(s1_entry = 1 OR s2_entry = 1 OR s3_long_entry = 1)"


def sql_eligible(score: str = "profile_score_blended", mask: str = "true", least: float = 55) -> str:
    return f"SELECT *, {score} AS strategy_score FROM {{t}} WHERE market_state_index IN ('trend_ok', 'neutral', 'range_bias') AND {mask} AND ({SIGNAL} OR coalesce({score} >= {least}, false))"


ORDER = "strategy_score DESC NULLS LAST, candidate_score DESC NULLS LAST, technical_score DESC NULLS LAST, code"


def sql_top() -> o.Chain:
    chain = sql_factors().table(sql_eligible())
    return chain.table(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {ORDER}) AS place FROM {{t}}) WHERE place <= 3")


# ---- Spark panels ----------------------------------------------------------------------------------------------------


def panel(s: SparkSession, d: str, recursive: tuple[str, ...], read: tuple[str, ...]) -> DataFrame:
    """What a signal reads: windows first, so that nothing travels behind the fold of the recursive indicators."""
    return ind.add_recursive(sg.add_windows(ind.add_panel(bars(s, d), ())).select("code", "date", *read), only=recursive)


def valued(s: SparkSession, d: str) -> DataFrame:
    return sg.add_valuation(bars(s, d))


def signals(s: SparkSession, d: str, read: tuple[str, ...] = sg.SIGNALS_READ) -> DataFrame:
    return sg.signal_panel(bars(s, d), cf.DEFAULT, sg.RECURSIVE, read)


def scored(s: SparkSession, d: str) -> DataFrame:
    return sg.add_candidate_score(signals(s, d))


#: What is read of a row whose eligibility is asked for, and what the switched profiles read beside it.
_BUY = ("market_state_index", "s1_entry", "s2_entry", "s3_long_entry")
_SWITCH = ("rsi14", "rvol20", "close", "ema20", "ema50", "ema200", "dist_high20", "clv", "body_ratio", "breakout20_atr", "boll_up", "roc20", "roc60")


def factors(s: SparkSession, d: str, days: tuple[str, ...] = ()) -> DataFrame:
    """The day's scores, and of the rows what days names."""
    return sg.factor_panel(bars(s, d), read=(), days=days)


def state(s: SparkSession, d: str) -> DataFrame:
    return sg.market_state(ind.add_bollinger(ind.add_dmi(bars(s, d))))


# ---- registration ----------------------------------------------------------------------------------------------------

_dmi = o.add_dmi(o.Chain())
register("stock_state", lambda s, d: ind.add_dmi(bars(s, d)).select("code", "date", sg.stock_state().alias("state")), _dmi.end("SELECT code, date, " + SIGNALS["market_state_stock"] + " AS state FROM {t}"))
_s1_reads, _s3_reads = ("close", "atr14", "atr_pct", "adx14", "rsi14", "obv", "_obv_before", "_obv_high"), ("close", "atr14", "atr_pct", "rsi14", "boll_low")
for _n, _add, _cols, _made, _read in (
    ("s1_signal", sg.add_s1, ["s1_entry", "s1_stop", "s1_pos"], ("ema20", "ema50", "ema200", "macd_hist"), _s1_reads), ("s2_signal", sg.add_s2, ["s2_entry", "s2_stop", "s2_pos"], (), sg.SIGNALS_READ),
    ("s3_signal", sg.add_s3, ["s3_long_entry", "s3_stop", "s3_pos"], ("ema20",), _s3_reads), ("s4_signal", sg.add_s4, ["s4_pyramid"], (), sg.SIGNALS_READ)):
    register(_n, lambda s, d, add=_add, cols=_cols, made=_made, read=_read: rounded(add(panel(s, d, made, read)), cols[1:], ("code", "date", cols[0])), sql_raw_signals(o.panel()).show(_cols[1:], plain=("code", "date", _cols[0])))
_assembled = ["s1_stop", "s1_pos", "s2_stop", "s2_pos", "s3_stop", "s3_pos"]
_flags = ("code", "date", "market_state_index", "market_state_stock", "s1_entry", "s2_entry", "s3_long_entry", "s4_pyramid")
register("assemble_signals", lambda s, d: rounded(signals(s, d), _assembled, _flags), sql_signals().show(_assembled, plain=_flags))
register("join_market_state", lambda s, d: bars(s, d).join(state(s, d), "date", "left").select("code", "date", "market_state_index"), sql_state(o.add_boll(_dmi)).end("SELECT code, date, market_state_index FROM {t} LEFT JOIN state USING (date)"))
register("technical_score", lambda s, d: rounded(signals(s, d).withColumn("technical_score", sg.technical_score()), ["technical_score"]), sql_signals().add(technical_score=TECHNICAL).show(["technical_score"]))
register("value_ml_score", lambda s, d: rounded(valued(s, d).withColumns({"predicted_return": F.when(F.col("code") % 2 == 0, F.col("pct_chg") / 100), "predicted_bin_rel": F.when(F.col("code") % 3 == 0, (F.col("code") % 5 + 1).cast("double"))}).withColumns({"value_score_100": sg.value_score_100(), "ml_score": sg.ml_score()}), ["value_score_100", "ml_score"]),
         sql_valuation(o.Chain()).add(value_score_100=VALUE100, ml_score="coalesce(CASE WHEN code % 2 = 0 THEN least(greatest(pct_chg / 100, -0.2), 0.2) * 250 + 50 END, CASE WHEN code % 3 = 0 THEN least(greatest((code % 5) / 4.0, 0), 1) * 100 END)").show(["value_score_100", "ml_score"]))
register("candidate_score", lambda s, d: rounded(scored(s, d), ["technical_score", "value_score_100", "candidate_score"]), sql_scored().show(["technical_score", "value_score_100", "candidate_score"]))
register("valuation_overlay", lambda s, d: rounded(sg.valuation_overlay(scored(s, d).where("s1_entry + s2_entry + s3_long_entry > 0"), 0.8), ["candidate_score"]),
         sql_scored().end(f"SELECT code, date, round(candidate_score, 6) AS candidate_score FROM {{t}} WHERE {SIGNAL} AND coalesce(pb_cs_rank <= 0.8, true) AND coalesce(ps_cs_rank <= 0.8, true)"))
register("valuation_note", lambda s, d: valued(s, d).select("code", "date", sg.valuation_note().alias("note")),
         sql_valuation(o.Chain()).end("SELECT code, date, concat_ws('|', 'valuation_ok', CASE WHEN pb_cs_rank IS NOT NULL THEN 'pb_rank=' || printf('%.2f', pb_cs_rank + 1e-12) END, CASE WHEN ps_cs_rank IS NOT NULL THEN 'ps_rank=' || printf('%.2f', ps_cs_rank + 1e-12) END) AS note FROM {t}"))
register("safe_log1p", lambda s, d: rounded(bars(s, d).withColumns({"pb_log": sg.safe_log1p("pb_mrq"), "ps_log": sg.safe_log1p("ps_ttm")}), ["pb_log", "ps_log"]), o.Chain().add(pb_log="CASE WHEN pb_mrq > 0 THEN ln(1 + pb_mrq) END", ps_log="CASE WHEN ps_ttm > 0 THEN ln(1 + ps_ttm) END").show(["pb_log", "ps_log"]))
register("value_score", lambda s, d: rounded(valued(s, d), ["value_score"]), sql_valuation(o.Chain()).show(["value_score"]))
register("cs_rank", lambda s, d: rounded(valued(s, d), ["pb_cs_rank", "ps_cs_rank"]), sql_valuation(o.Chain()).show(["pb_cs_rank", "ps_cs_rank"]))
_raws = [f"{f}_raw" for f in FACTORS]
register("factor_raw", lambda s, d: rounded(sg.add_raw_factors(signals(s, d, sg.FACTORS_READ)), _raws), sql_signals().add(**RAW).show(_raws))
_scores = [f"{f}_score" for f in FACTORS]
register("factor_scores", lambda s, d: rounded(factors(s, d), _scores), sql_factors().show(_scores))
_multi = ["multifactor_score", *[f"profile_score_{p}" for p in cf.PROFILES]]
register("multifactor_score", lambda s, d: rounded(factors(s, d), _multi), sql_factors().show(_multi))
register("profile_filter", lambda s, d: signals(s, d, sg.FACTORS_READ).select("code", "date", *[sg.profile_mask(p).alias(p) for p in MASKS]), sql_signals().end("SELECT code, date, " + ", ".join(f"{m} AS {p}" for p, m in MASKS.items()) + " FROM {t}"))
register("choose_strategy", lambda s, d: rounded(signals(s, d).withColumns({"strategy": sg.choose_strategy(), "stop": sg.stop_for_row()}), ["stop"], ("code", "date", "strategy")),
         sql_signals().add(strategy=STRATEGY, stop="CASE WHEN s2_entry = 1 THEN s2_stop WHEN s1_entry = 1 THEN s1_stop WHEN s3_long_entry = 1 THEN s3_stop ELSE close - 1.5 * atr14 END").show(["stop"], plain=("code", "date", "strategy")))
register("today_candidates", lambda s, d: rounded(sg.today_candidates(signals(s, d)), ["stop_ref", "pos_ref"], ("code", "date", "strategy", "confidence", "key_notes")),
         sql_signals().add(strategy=STRATEGY).end(f"""SELECT code, date, strategy, CAST(floor({TECHNICAL}) AS INT) AS confidence, round(CASE strategy WHEN 'S2' THEN s2_stop WHEN 'S1' THEN s1_stop ELSE s3_stop END, 6) AS stop_ref,
         round(CASE strategy WHEN 'S2' THEN s2_pos WHEN 'S1' THEN s1_pos ELSE s3_pos END, 6) AS pos_ref, CASE strategy WHEN 'S2' THEN '{sg.REASONS['s2'][1]}' WHEN 'S1' THEN '{sg.REASONS['s1'][1]}' ELSE '{sg.REASONS['s3'][1]}' END AS key_notes
         FROM {{t}} WHERE strategy <> 'MF' AND date = (SELECT max(date) FROM {{t}})"""))  # fmt: skip
register("market_state", lambda s, d: rounded(state(s, d), ["idx_adx14", "idx_bw", "idx_bw_q"], ("date", "bucket_id", "market_state_index")),
         sql_state(o.add_boll(_dmi)).end("SELECT date, bucket_id, market_state_index, round(idx_adx14, 6) AS idx_adx14, round(idx_bw, 6) AS idx_bw, round(idx_bw_q, 6) AS idx_bw_q FROM state"))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    order = wd().orderBy(F.round("multifactor_score", 9).desc_nulls_last(), "code")
    return factors(s, d).withColumn("rank_today", F.row_number().over(order)).select("code", "date", "rank_today")


register("rank_today", _ranked, sql_factors().end("SELECT code, date, row_number() OVER (PARTITION BY date ORDER BY round(multifactor_score, 9) DESC NULLS LAST, code) AS rank_today FROM {t}"))
register("eligible_universe", lambda s, d: rounded(sg.eligible(factors(s, d, (*_BUY, *_SWITCH)), cf.Portfolio(strategy_profile="meta_switch_rsi_vol")), ["strategy_score"], ("code", "date", "strategy_profile")),
         sql_factors().table("SELECT date, coalesce(mode(market_state_index), 'neutral') AS regime, median(rsi14) AS mrsi, median(rvol20) AS mvol FROM {t} GROUP BY date", "days")
         .table("SELECT p.*, CASE WHEN regime = 'trend_ok' AND mrsi >= 58 AND mvol >= 1 THEN 'quality_trend' WHEN regime = 'trend_ok' AND mrsi >= 52 THEN 'pullback_quality_combo' WHEN regime = 'range_bias' OR mrsi < 48 THEN 'pullback' ELSE 'pullback_quality_combo' END AS strategy_profile FROM {t} p JOIN days USING (date)")
         .table(f"SELECT *, CASE strategy_profile WHEN 'quality_trend' THEN profile_score_quality_trend WHEN 'pullback' THEN profile_score_pullback ELSE profile_score_pullback_quality_combo END AS strategy_score, CASE strategy_profile WHEN 'quality_trend' THEN {STRONG} WHEN 'pullback' THEN {NEAR} ELSE ({STRONG} OR {NEAR}) END AS fits FROM {{t}}")
         .show(["strategy_score"], f"market_state_index IN ('trend_ok', 'neutral', 'range_bias') AND fits AND ({SIGNAL} OR coalesce(strategy_score >= 55, false))", ("code", "date", "strategy_profile")))

_exposure = sql_top().table("SELECT date, avg(strategy_score) AS avg_top, coalesce(mode(market_state_index), 'neutral') AS regime FROM {t} GROUP BY date", "tops").table(
    "SELECT date, least(greatest(CASE regime WHEN 'trend_ok' THEN 0.45 + 0.25 * k WHEN 'range_bias' THEN 0.35 ELSE 0.15 + 0.30 * k END, 0.15), 0.70) AS target_exposure FROM (SELECT *, least(greatest((avg_top - 55) / 37.0, 0), 1) AS k FROM tops)", "exposure")
register("target_exposure", lambda s, d: rounded(sg.add_exposure(sg.top_of_day(factors(s, d, _BUY))).select("date", "target_exposure").distinct(), ["target_exposure"], ("date",)), _exposure.end("SELECT date, round(target_exposure, 6) AS target_exposure FROM exposure"))
register("alloc_weights", lambda s, d: rounded(sg.add_weights(sg.add_exposure(sg.top_of_day(factors(s, d, _BUY)))), ["target_weight"], ("code", "date", "place")),
         _exposure.table("SELECT p.*, target_exposure, greatest(coalesce(strategy_score, 55) - 55, 1) AS raw FROM {t} p JOIN exposure USING (date)")
         .add(_w="least(greatest(raw / sum(raw) OVER (PARTITION BY date) * target_exposure, 0.10), 0.35)")
         .add(target_weight="least(_w * target_exposure / greatest(sum(_w) OVER (PARTITION BY date), 1e-9), 0.35)").show(["target_weight"], plain=("code", "date", "place")))


# ---- buckets, quantile cuts, quality of valuation columns -------------------------------------------------------------


def sql_qcut(table: str, value: str, k: int, by: str = "", tie: str = "code") -> str:
    """Bin 1..k of the value's place; borders are at 1 + (n - 1) j / k, exact in whole numbers."""
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT *, CASE WHEN n = 0 THEN NULL ELSE 1 + (SELECT count(*) FROM range(1, {k}) g(j) WHERE (r - 1) * {k} > (n - 1) * j) END AS bin FROM (SELECT *, row_number() OVER ({part}ORDER BY {value}, {tie}) AS r, count(*) OVER ({part[:-1]}) AS n FROM {table} WHERE {value} IS NOT NULL)"


_monthly = "SELECT code, date_trunc('month', date) AS ym, {agg} AS v FROM {{t}} GROUP BY 1, 2"
_frozen = "SELECT code, max_by(v, ym) AS v FROM {t} GROUP BY 1"
register("bucket_map_size", lambda s, d: buckets.monthly_freeze(bars(s, d), "size", 3).select("code", "bucket_id"), o.Chain().table(_monthly.format(agg="max_by(close, date)")).table(_frozen).table(sql_qcut("{t}", "v", 3)).end("SELECT code, bin - 1 AS bucket_id FROM {t}"))
register("bucket_map_vol", lambda s, d: buckets.monthly_freeze(bars(s, d), "vol", 3).select("code", "bucket_id"),
         o.Chain().add(_r=o.roc("close", 1)).table(_monthly.format(agg="stddev_samp(_r)")).table("SELECT code, arg_max_null(v, ym) AS v FROM {t} GROUP BY 1").table(sql_qcut("{t}", "round(v, 12)", 3)).end("SELECT code, bin - 1 AS bucket_id FROM {t}"))
register("join_bucket", lambda s, d: bars(s, d).join(buckets.monthly_freeze(bars(s, d), "size", 3), "code", "left").select("code", "date", "bucket_id"),
         o.Chain().table(_monthly.format(agg="max_by(close, date)").replace("{{t}}", "bars"), "m0").table("SELECT code, max_by(v, ym) AS v FROM m0 GROUP BY 1", "m1").table(sql_qcut("m1", "v", 3), "m2").end("SELECT b.code, b.date, bin - 1 AS bucket_id FROM bars b LEFT JOIN m2 USING (code)"))
register("qcut", lambda s, d: buckets.qcut(bars(s, d).select("code", "date", "close", "volume"), "close", 5, ["date"], ["code"]).select("code", "date", "bin"), o.Chain().table(sql_qcut("{t}", "close", 5, "date")).end("SELECT code, date, bin FROM {t}"))
register("valuation_quality", lambda s, d: buckets.column_quality(bars(s, d), ["pb_mrq", "ps_ttm"]),
         o.Chain().end(" UNION ALL ".join(f"SELECT '{x}' AS metric, count(*) AS rows, round(avg(({x} IS NULL)::INT), 6) AS missing_rate, round(avg(coalesce({x} <= 0, false)::INT), 6) AS non_positive_rate, round(avg(coalesce({x} > 0, false)::INT), 6) AS positive_rate, " + ", ".join(f"round(quantile_cont({x}, {q}), 6) AS {n}" for n, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99))) + " FROM {t}" for x in ("pb_mrq", "ps_ttm"))))
register("cap_position", lambda s, d: rounded(bars(s, d).withColumn("capped", F.least(F.greatest(F.col("turnover") * 50, F.lit(0.0)), F.lit(0.2))), ["capped"]), o.Chain().add(capped="least(greatest(turnover * 50, 0.0), 0.2)").show(["capped"]))
register("month_add", lambda s, d: bars(s, d).select("date").distinct().select("date", F.add_months("date", 1).alias("m1"), F.add_months("date", -3).alias("m3"), F.add_months("date", 12).alias("m12")),
         o.Chain().end("SELECT DISTINCT date, CAST(date + INTERVAL 1 MONTH AS DATE) AS m1, CAST(date - INTERVAL 3 MONTH AS DATE) AS m3, CAST(date + INTERVAL 12 MONTH AS DATE) AS m12 FROM {t}"))
