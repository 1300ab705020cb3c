"""Rule signals: stock state, market state, S1-S4, their assembly, valuation ranks, candidate scores, factor scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklane import config as cf
from ticklane.functions import folds as fd
from ticklane.functions import indicators as ind
from ticklane.functions.base import b, c, clip, div, lag, near, rolling_max, wd


def cs_rank(x: str) -> Column:
    """Percentile rank among a date's codes: average of ties, null stays null."""
    by_value = F.rank().over(wd().orderBy(c(x).asc_nulls_last()))
    ties = F.count(c(x)).over(wd().orderBy(c(x).asc_nulls_last()).rangeBetween(W.currentRow, W.currentRow))  # peers: the same sort
    return F.when(c(x).isNotNull(), (by_value + (ties - 1) / F.lit(2.0)) / F.count(c(x)).over(wd()))


def safe_log1p(x: str) -> Column:
    return F.when(c(x) > 0, F.log1p(c(x)))


def add_valuation(df: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """pb/ps logs, cross-section and rolling ranks, value_score (null unless both ranks are there)."""
    return add_valuation_ranks(add_valuation_history(df, cfg), cfg)


def add_valuation_history(df: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """What of the valuation depends on a code's own rows: pb/ps logs and rolling ranks."""
    df = df.withColumns({"pb_log": safe_log1p("pb_mrq"), "ps_log": safe_log1p("ps_ttm")})
    return ind.add_pct_ranks(df, cfg.valuation.rolling_window, 20, pb_rolling_rank="pb_mrq", ps_rolling_rank="ps_ttm")


def add_valuation_ranks(df: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """What of it depends on a day's codes: cross-section ranks and value_score."""
    v = cfg.valuation
    df = df.withColumns({"pb_cs_rank": cs_rank("pb_mrq"), "ps_cs_rank": cs_rank("ps_ttm")})
    total = v.pb_weight + v.ps_weight
    return df.withColumn("value_score", (1 - F.col("pb_cs_rank")) * (v.pb_weight / total) + (1 - F.col("ps_cs_rank")) * (v.ps_weight / total))


def stock_state(cfg: cf.Config = cf.DEFAULT) -> Column:
    adx = F.col("adx14")
    return F.when(adx >= cfg.stock_state.adx_trend_th, "trend").when(adx < cfg.stock_state.adx_range_th, "range").when(adx.isNotNull(), "neutral")


def market_state(panel: DataFrame, cfg: cf.Config = cf.DEFAULT, bucket: bool = False) -> DataFrame:
    """date, bucket_id, idx_adx14, idx_bw, idx_bw_q, market_state_index: medians of a day and the width's rank among days."""
    g = cfg.index_gate
    if not bucket:
        panel = panel.withColumn("bucket_id", F.lit(0))
    days = medians(panel, ["date", "bucket_id"], {"idx_adx14": "adx14", "idx_bw": "boll_bw"})
    line = W.partitionBy("bucket_id").orderBy("date").rowsBetween(-(g.bw_window - 1), 0)
    x = near("idx_bw")
    values = F.collect_list(x).over(line)
    rank = (F.size(F.filter(values, lambda v: v < x)) + (F.size(F.filter(values, lambda v: v == x)) + 1) / F.lit(2.0)) / F.size(values)
    days = days.withColumn("idx_bw_q", F.when(F.count("idx_bw").over(line) == g.bw_window, rank))
    wide, adx = F.col("idx_bw_q") > g.bw_low_quantile, F.col("idx_adx14")
    state = F.when(b((adx >= g.adx_trend_th) & wide), "trend_ok").when(b((adx < g.adx_range_th) & ~wide), "range_bias").otherwise("neutral")
    return days.withColumn("market_state_index", state)


def medians(df: DataFrame, by: list[str], named: dict[str, str]) -> DataFrame:
    """Medians of a day's codes, name -> column, null where there is no value.

    A fold of the day's rows, dealt narrow: the aggregate of exact percentiles keeps a map of every task's values for every day.
    """
    schema = T.StructType([*(df.schema[x] for x in by), *(T.StructField(n, T.DoubleType()) for n in named)])

    def folded(rows: pa.Table) -> pa.Table:
        kept = (x[x == x] for x in (fd.values(rows, x) for x in named.values()))
        return fd.with_figures(rows.select(by).slice(0, 1), {n: np.array([np.median(x) if len(x) else np.nan]) for n, x in zip(named, kept, strict=True)})

    return df.select(*by, *dict.fromkeys(named.values())).groupBy(*by).applyInArrow(folded, schema)


def _obv_high(n: int) -> Column:
    return F.col("obv") >= rolling_max("obv", n)


def _size(cfg: cf.Config, mul: float) -> Column:
    """Position by risk per trade over the stop's distance, capped."""
    return F.least(F.lit(cfg.risk.per_trade_risk_pct) / F.nullif(mul * F.col("atr_pct"), F.lit(0.0)), F.when(F.col("atr_pct").isNotNull() & (F.col("atr_pct") != 0), F.lit(cfg.risk.max_pos_per_stock)))


def add_windows(df: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """df with what signals read of a code's rows before: made once where many settings read the same rows (see add_s1, add_s2, add_s4).

    Of the settings it reads the lookbacks and the width's window alone.
    """
    made = {"_adx_before": lag("adx14"), "_obv_before": lag("obv", cfg.s1.obv_lookback), "_obv_high": _obv_high(cfg.s1.obv_lookback), "_bw": near("boll_bw")}
    return ind.add_pct_ranks(df.withColumns(made), cfg.s2.bw_quantile_window, bw_q="_bw").drop("_bw")


def windows_of(cfg: cf.Config = cf.DEFAULT) -> dict[str, tuple]:
    """The same for ind.folded_panel()."""
    n = cfg.s1.obv_lookback
    return {"_adx_before": ("lag", "adx14", 1), "_obv_before": ("lag", "obv", n), "_obv_high": ("high", "obv", n), "bw_q": ("near_rank", "boll_bw", cfg.s2.bw_quantile_window)}


#: What add_windows() makes.
WINDOWS = ("_adx_before", "_obv_before", "_obv_high", "bw_q")


def _before(df: DataFrame, name: str, made: Column) -> Column:
    return F.col(name) if name in df.columns else made


def add_s1(df: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """Pullback to the fast EMA in a rising trend."""
    s = cfg.s1
    hit = (F.col("ema50") > F.col("ema200")) & (F.col("adx14") >= cfg.stock_state.adx_trend_th) & (F.abs(F.col("close") - F.col("ema20")) <= s.atr_mul_pullback * F.col("atr14"))
    hit = hit & (F.col("macd_hist") > 0) & (F.col("rsi14") >= s.rsi_bull_low)
    if s.obv_confirm:
        hit = hit & (b(F.col("obv") - _before(df, "_obv_before", lag("obv", s.obv_lookback)) > 0) | b(_before(df, "_obv_high", _obv_high(s.obv_lookback))))
    return df.withColumns({"s1_entry": b(hit).cast("int"), "s1_stop": F.col("close") - s.atr_mul * F.col("atr14"), "s1_pos": _size(cfg, s.atr_mul)})


def add_s2(df: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """Breakout from a squeeze of the bands."""
    s = cfg.s2
    if "bw_q" not in df.columns:
        df = ind.add_pct_ranks(df.withColumn("_bw", near("boll_bw")), s.bw_quantile_window, bw_q="_bw")
    hit = (F.col("bw_q") <= s.bw_quantile) & (F.col("close") > F.col("boll_up")) & (F.col("adx14") > _before(df, "_adx_before", lag("adx14")))
    if s.obv_confirm:
        hit = hit & _before(df, "_obv_high", _obv_high(cfg.s1.obv_lookback))
    return df.withColumns({"s2_entry": b(hit).cast("int"), "s2_stop": F.col("boll_mid") - s.atr_stop_mul * F.col("atr14"), "s2_pos": _size(cfg, s.atr_stop_mul)}).drop("_bw")


def add_s3(df: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """Reversion to the mean from the lower band."""
    s = cfg.s3
    low = b(F.col("close") <= F.col("boll_low")) | b(F.col("close") <= F.col("ema20") - s.atr_n * F.col("atr14"))
    return df.withColumns({"s3_long_entry": (b(F.col("rsi14") <= s.rsi_buy) & low).cast("int"), "s3_stop": F.col("close") - s.atr_stop_mul * F.col("atr14"), "s3_pos": _size(cfg, s.atr_stop_mul)})


def add_s4(df: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """Adding to a position: trend strength, momentum and volume together."""
    hit = (F.col("plus_di14") > F.col("minus_di14")) & (F.col("adx14") > _before(df, "_adx_before", lag("adx14"))) & (b(F.col("cci20") > cfg.s4.cci_th) | b(F.col("roc10") > 0))
    hit = hit & _before(df, "_obv_high", _obv_high(cfg.s1.obv_lookback))
    return df.withColumn("s4_pyramid", b(hit).cast("int"))


# The reasons that entries carry.
REASONS = {
    "s1": ("s1_entry", "pullback_to_ema20 & macd_hist>0 & rsi_bull & obv_confirm"),
    "s2": ("s2_entry", "squeeze_breakout & adx_rising & obv_confirm"),
    "s3": ("s3_long_entry", "mean_revert_long: rsi_low & near_lower_band"),
    "s4": ("s4_pyramid", "trend_momo_volume: +DI>-DI & ADX↑ & CCI/ROC & OBV_breakout"),
}


def assemble(panel: DataFrame, state: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """Signals of a panel, gated by the day's market state and the stock's own.

    state has a row for each date (and bucket): the calendar bounds it, whatever the number of codes, so it is broadcast and the
    panel stays with its codes.
    """
    keys = ["date", "bucket_id"] if "bucket_id" in panel.columns else ["date"]
    df = panel.join(F.broadcast(state.select(*keys, "market_state_index")), keys, "left").withColumn("market_state_stock", stock_state(cfg))
    df = add_s4(add_s3(add_s2(add_s1(df, cfg), cfg), cfg), cfg)
    index_ok = b(F.col("market_state_index").isin("trend_ok", "neutral"))
    trend, ranging = b(F.col("market_state_stock") == "trend"), b(F.col("market_state_stock") == "range")
    gates = {"s1_entry": index_ok & trend, "s2_entry": index_ok, "s3_long_entry": ranging, "s4_pyramid": index_ok & trend}
    df = df.withColumns({k: F.when(gate, F.col(k)).otherwise(0) for k, gate in gates.items()})
    return df.withColumns({f"{s}_reason": F.when(F.col(k) == 1, said).otherwise("") for s, (k, said) in REASONS.items()})


def technical_score() -> Column:
    raw = F.coalesce(clip(F.col("adx14"), 0.0, 100.0), F.lit(0.0)) + 20.0 * F.col("s2_entry") + 10.0 * F.col("s1_entry") + 8.0 * F.col("s3_long_entry")
    return F.least(F.lit(100.0), raw / 2)


def value_score_100() -> Column:
    """value_score in percent, else the mean of the cheapness ranks that are there."""
    ranks = [1 - F.col("pb_cs_rank"), 1 - F.col("ps_cs_rank")]
    there = sum(r.isNotNull().cast("int") for r in ranks)
    return F.coalesce(clip(F.col("value_score"), 0.0, 1.0) * 100, div(sum(F.coalesce(r, F.lit(0.0)) for r in ranks), there.cast("double")) * 100)


def ml_score(predicted: str = "predicted_return", bin_rel: str = "predicted_bin_rel") -> Column:
    return F.coalesce(clip(c(predicted), -0.2, 0.2) * 250 + 50, clip((c(bin_rel) - 1) / 4, 0.0, 1.0) * 100)


def add_candidate_score(df: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """technical, value and model scores and their weighted mean over those that are there."""
    for name in ("predicted_return", "predicted_bin_rel"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    v = cfg.valuation
    if "technical_score" not in df.columns:
        df = df.withColumn("technical_score", technical_score())
    df = df.withColumns({"value_score_100": value_score_100(), "ml_score": ml_score()})
    weights = {"technical_score": v.tech_weight, "value_score_100": v.value_weight, "ml_score": v.ml_weight}
    total = sum(weights.values())
    parts = [(F.col(k), x / total) for k, x in weights.items() if x > 0] if total > 0 else [(F.col("technical_score"), 1.0)]
    return df.withColumn("candidate_score", div(sum(F.coalesce(k, F.lit(0.0)) * x for k, x in parts), sum(k.isNotNull().cast("double") * x for k, x in parts)))


def value_allowed(cfg: cf.Config = cf.DEFAULT) -> Column:
    """May a row be entered at its valuation? Ranks that are missing never forbid."""
    cut = cfg.valuation.expensive_cut
    if not cfg.valuation.enabled or cfg.valuation.mode == "rank_only":
        return F.lit(True)
    return F.coalesce(F.col("pb_cs_rank") <= cut, F.lit(True)) & F.coalesce(F.col("ps_cs_rank") <= cut, F.lit(True))


def valuation_overlay(candidates: DataFrame, cut: float, filtering: bool = True) -> DataFrame:
    """Candidates that are not too expensive, best first."""
    if filtering:
        candidates = candidates.where(F.coalesce(F.col("pb_cs_rank") <= cut, F.lit(True)) & F.coalesce(F.col("ps_cs_rank") <= cut, F.lit(True)))
    return candidates.orderBy(F.col("candidate_score").desc_nulls_last(), F.col("code"))


def valuation_note() -> Column:
    shown = lambda name, x: F.when(c(x).isNotNull(), F.concat(F.lit(f"{name}="), F.format_string("%.2f", c(x))))
    return F.concat_ws("|", F.lit("valuation_ok"), shown("pb_rank", "pb_cs_rank"), shown("ps_rank", "ps_cs_rank"))


def choose_strategy() -> Column:
    return F.when(F.col("s2_entry") == 1, "S2").when(F.col("s1_entry") == 1, "S1").when(F.col("s3_long_entry") == 1, "S3").otherwise("MF")


def stop_for_row() -> Column:
    return F.when(F.col("s2_entry") == 1, F.col("s2_stop")).when(F.col("s1_entry") == 1, F.col("s1_stop")).when(F.col("s3_long_entry") == 1, F.col("s3_stop")).otherwise(F.col("close") - 1.5 * F.col("atr14"))


def today_candidates(signals: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """Last day's entries with the stop and size of the strategy chosen."""
    last = signals.agg(F.max("date").alias("_last"))
    df = signals.join(F.broadcast(last), F.col("date") == F.col("_last")).drop("_last")
    strategy = choose_strategy()
    df = df.withColumn("strategy", strategy).where("strategy <> 'MF'")
    by = lambda kind: F.when(F.col("strategy") == "S2", F.col(f"s2_{kind}")).when(F.col("strategy") == "S1", F.col(f"s1_{kind}")).otherwise(F.col(f"s3_{kind}"))
    df = df.withColumns({"confidence": F.floor(technical_score()).cast("int"), "stop_ref": by("stop"), "pos_ref": by("pos"), "key_notes": by("reason")})
    return df.where(value_allowed(cfg))


def add_raw_factors(df: DataFrame) -> DataFrame:
    """The eight raw factors."""
    return add_own_factors(df).withColumn("value_factor_raw", F.col("value_score"))


def add_own_factors(df: DataFrame) -> DataFrame:
    """The seven raw factors that depend on a code's own rows."""
    x, zero = F.col, F.lit(0.0)
    fill = lambda k, v=0.0: F.coalesce(k if isinstance(k, Column) else x(k), F.lit(v))
    flag = lambda p: b(p).cast("double")
    return df.withColumns({
        "trend_raw": 0.35 * flag(x("ema20") > x("ema50")) + 0.35 * flag(x("ema50") > x("ema200")) + 0.20 * clip(x("adx14") / 50, 0.0, 1.0)
        + 0.10 * clip((x("plus_di14") - x("minus_di14")) / 50, -1.0, 1.0),
        "momentum_raw": 0.35 * fill("roc10") + 0.35 * fill("macd_hist") + 0.15 * fill("cci20") + 0.15 * fill(div("close", "ema20") - 1),
        "medium_term_raw": 0.30 * fill("roc20") + 0.30 * fill("roc60") + 0.20 * fill(clip(x("breakout20_atr"), -3.0, 3.0)) + 0.10 * fill("dist_high60", -0.10) + 0.10 * (1 + fill("mdd60", -0.30)),
        "signal_raw": x("s2_entry") + 0.8 * x("s1_entry") + 0.6 * x("s3_long_entry") + 0.4 * x("s4_pyramid") + F.when(b(x("market_state_index") == "trend_ok"), 0.2).otherwise(zero),
        "quality_raw": 0.30 * fill("clv") + 0.20 * fill("body_ratio") + 0.10 * fill("lower_wick_ratio") + 0.15 * fill(clip(x("rvol20"), 0.0, 4.0), 1.0)
        - 0.15 * fill(clip(x("gap_atr14"), 0.0, 3.0)) - 0.10 * fill(clip(x("tr_pct"), 0.0, 0.2)),
        "risk_raw": -x("atr_pct"), "liquidity_raw": x("turnover"),
    })


def add_factor_scores(df: DataFrame) -> DataFrame:
    """Percentile of each raw factor on its day, 50 where there is none."""
    df = df.withColumns({f"_{f}": near(f"{f}_raw") for f in cf.FACTORS})
    df = df.withColumns({f"{f}_score": F.coalesce(cs_rank(f"_{f}"), F.lit(0.5)) * 100 for f in cf.FACTORS})
    return df.drop(*[f"_{f}" for f in cf.FACTORS])


def day_scores(df: DataFrame, keep: tuple[str, ...], cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """add_valuation_ranks() and add_factor_scores() of code, date and keep, in one fold of a day's rows.

    As windows, each of the ten ranks sorts the day's rows anew, and a window keeps a day of more than some thousand rows in a sorter
    of its own.  Rows leave the fold without a partitioning that Spark knows: for what reads a few columns behind it.
    """
    v, own = cfg.valuation, [f for f in cf.FACTORS if f != "value_factor"]
    made = ["pb_cs_rank", "ps_cs_rank", "value_score", *(f"{f}_score" for f in cf.FACTORS)]
    held = list(dict.fromkeys(["code", "date", *keep]))
    pb, ps = v.pb_weight / (v.pb_weight + v.ps_weight), v.ps_weight / (v.pb_weight + v.ps_weight)
    schema = T.StructType([*(df.schema[x] for x in held), *(T.StructField(n, T.DoubleType()) for n in made)])

    def folded(rows: pa.Table) -> pa.Table:
        out = {"pb_cs_rank": fd.rank_of_all(fd.values(rows, "pb_mrq")), "ps_cs_rank": fd.rank_of_all(fd.values(rows, "ps_ttm"))}
        out["value_score"] = (1 - out["pb_cs_rank"]) * pb + (1 - out["ps_cs_rank"]) * ps
        for f in cf.FACTORS:
            rank = fd.rank_of_all(fd.near(out["value_score"] if f == "value_factor" else fd.values(rows, f"{f}_raw")))
            out[f"{f}_score"] = np.where(np.isnan(rank), 0.5, rank) * 100
        return fd.with_figures(rows.select(held), {n: out[n] for n in made})

    return df.select(*dict.fromkeys([*held, "pb_mrq", "ps_ttm", *(f"{f}_raw" for f in own)])).groupBy("date").applyInArrow(folded, schema)


def add_multifactor(df: DataFrame) -> DataFrame:
    """multifactor_score, a score for each profile, and the reason text."""
    mean = lambda ws: sum(F.col(f"{f}_score") * x for f, x in zip(cf.FACTORS, ws, strict=True)) / F.lit(sum(ws))
    df = df.withColumns({"multifactor_score": mean(cf.COMPOSITE)} | {f"profile_score_{p}": mean(ws) for p, ws in cf.PROFILES.items()})
    names = {"trend": "trend", "mom": "momentum", "mid": "medium_term", "signal": "signal", "quality": "quality", "value": "value_factor", "risk": "risk"}
    said = [F.concat(F.lit(f"{k}="), F.format_string("%.1f", F.round(F.col(f"{f}_score"), 1))) for k, f in names.items()]
    return df.withColumn("composite_reason", F.concat_ws("|", *said))


def profile_mask(profile: str) -> Column:
    """Rows that a profile trades."""
    x = F.col
    rising = b((x("ema50") > x("ema200")) & (x("close") > x("ema20")))
    near_high = (x("s1_entry") == 1) | (rising & b((x("dist_high20") > -0.08) & (x("dist_high20") < -0.01)))
    strong = rising & b((x("clv") > 0) & (x("body_ratio") > 0.35))
    return {
        "breakout": (x("s2_entry") == 1) | b(x("breakout20_atr") > 0) | b(x("close") > x("boll_up")),
        "pullback": near_high,
        "mid_momo": rising & b((x("roc20") > 0) & (x("roc60") > 0)),
        "quality_trend": strong,
        "value_trend": rising & b(x("value_score") > 0.55),
        "pullback_quality_combo": strong | near_high,
    }.get(profile, F.lit(True))


#: Profiles that trade some rows only; others trade all.
MASKED = ("breakout", "pullback", "mid_momo", "quality_trend", "value_trend", "pullback_quality_combo")


def active_profile(profile: str) -> Column:
    """Profile of a day: fixed, or switched by the day's state and, for meta_switch_rsi_vol, its median RSI and volume."""
    if profile not in SWITCHED:
        return F.lit(profile)
    return _switched(profile, *(e.over(wd()) for e in _day_medians()))


def switched_days(df: DataFrame, profiles: list[str]) -> DataFrame:
    """date and switch_x for each switched profile x: a row a day."""
    days = df.groupBy("date").agg(*[e.alias(n) for e, n in zip(_day_medians(), ("_state", "_rsi", "_volume"), strict=True)])
    return days.select("date", *[_switched(p, F.col("_state"), F.col("_rsi"), F.col("_volume")).alias(f"switch_{p}") for p in profiles])


def _day_medians() -> tuple[Column, Column, Column]:
    return F.mode("market_state_index", deterministic=True), F.median("rsi14"), F.median("rvol20")


def _switched(profile: str, state: Column, rsi: Column, volume: Column) -> Column:
    regime = F.coalesce(state, F.lit("neutral"))
    if profile == "regime_switch":
        return F.when(regime == "trend_ok", "quality_trend").when(regime == "range_bias", "pullback").otherwise("pullback_quality_combo")
    up = regime == "trend_ok"
    return (
        F.when(b(up & (rsi >= 58) & (volume >= 1)), "quality_trend").when(b(up & (rsi >= 52)), "pullback_quality_combo")
        .when(b((regime == "range_bias") | (rsi < 48)), "pullback").otherwise("pullback_quality_combo"))


SWITCHED = ("regime_switch", "meta_switch_rsi_vol")


def eligibility(p: cf.Portfolio, profile: Column | None = None, made: bool = False) -> tuple[Column, Column]:
    """Score of a row under a portfolio's profile and whether it may be bought. profile: a switched day's profile, as a column;
    made: the columns signal and fits_x of each masked profile x are there."""
    masked = (lambda n: F.col(f"fits_{n}") if n in MASKED else F.lit(True)) if made else profile_mask
    if p.strategy_profile in SWITCHED:
        names = ("quality_trend", "pullback", "pullback_quality_combo")
        score, mask = F.lit(None).cast("double"), F.lit(False)
        for n in names:
            score = F.when(profile == n, F.col(f"profile_score_{n}")).otherwise(score)
            mask = F.when(profile == n, masked(n)).otherwise(mask)
    else:
        name = f"profile_score_{p.strategy_profile}"
        score, mask = F.col(name if p.strategy_profile in cf.PROFILES else "multifactor_score"), masked(p.strategy_profile)
    signal = F.col("signal") if made else (F.col("s1_entry") == 1) | (F.col("s2_entry") == 1) | (F.col("s3_long_entry") == 1)
    return score, F.coalesce(F.col("market_state_index").isin("trend_ok", "neutral", "range_bias"), F.lit(False)) & mask & (signal | b(score >= p.min_score))


def eligible(df: DataFrame, p: cf.Portfolio = cf.DEFAULT.portfolio) -> DataFrame:
    """Rows of each day that the portfolio may buy, with strategy_profile and strategy_score."""
    df = df.withColumn("strategy_profile", active_profile(p.strategy_profile))
    score, fits = eligibility(p, F.col("strategy_profile"), "fits_pullback" in df.columns)
    return df.withColumn("strategy_score", score).where(fits)


def eligible_order() -> list[Column]:
    return [F.col("strategy_score").desc_nulls_last(), F.col("candidate_score").desc_nulls_last(), F.col("technical_score").desc_nulls_last(), F.col("code")]


def top_of_day(df: DataFrame, p: cf.Portfolio = cf.DEFAULT.portfolio) -> DataFrame:
    """The first top_n eligible rows of each day, numbered by place."""
    return eligible(df, p).withColumn("place", F.row_number().over(wd().orderBy(*eligible_order()))).where(F.col("place") <= p.top_n)


def exposure(mean_score: Column, state: Column, least: Column, low: Column, base: Column, high: Column) -> Column:
    """Target exposure of a day by its mean top score above the least one and by its most frequent state."""
    strength = clip((mean_score - least) / F.greatest(92.0 - least, F.lit(1e-6)), 0.0, 1.0)
    target = F.when(state == "trend_ok", base + (high - base) * strength).when(state == "range_bias", F.least(base, F.lit(0.35))).otherwise(low + (base - low) * strength)
    return F.when(target < low, low).when(target > high, high).otherwise(target)


def add_exposure(top: DataFrame, p: cf.Portfolio = cf.DEFAULT.portfolio) -> DataFrame:
    """target_exposure of a day by its top rows."""
    state = F.coalesce(F.mode("market_state_index", deterministic=True).over(wd()), F.lit("neutral"))
    bounds = (F.lit(float(x)) for x in (p.min_score, p.min_total_exposure, p.base_total_exposure, p.max_total_exposure))
    return top.withColumn("target_exposure", exposure(F.avg("strategy_score").over(wd()), state, *bounds))


def add_weights(top: DataFrame, p: cf.Portfolio = cf.DEFAULT.portfolio) -> DataFrame:
    """target_weight in proportion to the score above the least one, within bounds, scaled to the exposure, capped."""
    raw = F.greatest(F.coalesce("strategy_score", F.lit(p.min_score)) - p.min_score, F.lit(1.0))
    df = top.withColumn("_raw", raw).withColumn("_w", clip(F.col("_raw") / F.sum("_raw").over(wd()) * F.col("target_exposure"), p.min_position_weight, p.max_position_weight))
    scaled = F.col("_w") * F.col("target_exposure") / F.greatest(F.sum("_w").over(wd()), F.lit(1e-9))
    return df.withColumn("target_weight", F.least(scaled, F.lit(p.max_position_weight))).drop("_raw", "_w")


#: What signals and factors read of the recursive indicators, what signals read of a row besides, and what factors read beside that.
RECURSIVE = ("ema20", "ema50", "ema200", "macd_dif", "macd_dea", "macd_hist")
SIGNALS_READ = ("close", "atr14", "atr_pct", "adx14", "rsi14", "obv", "boll_mid", "boll_up", "boll_low", "plus_di14", "minus_di14", "cci20", "roc10", "pb_mrq", "ps_ttm", *WINDOWS)
FACTORS_READ = (
    *SIGNALS_READ, "roc20", "roc60", "breakout20_atr", "dist_high20", "dist_high60", "mdd60", "clv", "body_ratio", "lower_wick_ratio", "rvol20", "gap_atr14", "tr_pct", "turnover",
)


def own_signals(bars: DataFrame, cfg: cf.Config = cf.DEFAULT, recursive: tuple[str, ...] | None = None, read: tuple[str, ...] | None = None, ahead: dict[str, Column] | None = None) -> DataFrame:
    """Bars to signals without the valuation's ranks of a day: all windows are over a code's rows, which travel once.

    All indicators are made in one fold (recursive: those of the recursive ones that are wanted), and nothing travels behind it.  Spark
    cannot tell what is read behind a fold: read names the columns to be kept beside code, date and the signals' own (none: all); ahead:
    further windows by code, before it.  The market state reads two columns, which a narrow fold makes anew from the bars.
    """
    state = market_state(ind.folded_panel(bars, ("adx14", "boll_bw"), ()), cfg)
    named = ind.NAMES if recursive is None else (*ind.ROLLING, *recursive)
    df = bars.withColumns({"pb_log": safe_log1p("pb_mrq"), "ps_log": safe_log1p("ps_ttm"), "clv": ind.clv()} | ind.wick_ratios() | (ahead or {}))
    windows = windows_of(cfg)
    if read is None:
        windows |= {n: ("rank", x, cfg.valuation.rolling_window, 20) for n, x in (("pb_rolling_rank", "pb_mrq"), ("ps_rolling_rank", "ps_ttm"))}
        keep = df.columns
    else:
        read = {*SIGNALS_READ, *read}
        keep, named = [n for n in df.columns if n in read or n in (ahead or {})], [n for n in named if n in read or n in (recursive or ())]
    df = ind.folded_panel(df, named, keep, windows)
    return assemble(df, state, cfg).drop(*(x for x in WINDOWS if x.startswith("_")))


def signal_panel(bars: DataFrame, cfg: cf.Config = cf.DEFAULT, recursive: tuple[str, ...] | None = None, read: tuple[str, ...] | None = None) -> DataFrame:
    """Bars to signals: indicators, valuation ranks, market state, gated signals.  recursive, read: as for own_signals()."""
    return add_valuation_ranks(own_signals(bars, cfg, recursive, read), cfg)


def factor_panel(
    bars: DataFrame, cfg: cf.Config = cf.DEFAULT, own: dict[str, Column] | None = None, read: tuple[str, ...] | None = None, ahead: dict[str, Column] | None = None, days: tuple[str, ...] | None = None
) -> DataFrame:
    """Bars to factor and profile scores.

    Raw factors are made before rows are dealt to their days, so only what is asked for travels.  read: columns of bars and indicators
    that are wanted beside those that factors read (none: all); ahead: further windows by code, own: what is made of them and of signals.
    days: what is read behind the day's ranks, beside what they make; then day_scores() makes them (none: windows, which keep all columns).
    """
    df = add_own_factors(own_signals(bars, cfg, RECURSIVE, None if read is None else (*FACTORS_READ, *read), ahead)).withColumns({"technical_score": technical_score()} | (own or {}))
    if days is not None:
        return add_multifactor(add_candidate_score(day_scores(df, ("technical_score", *days), cfg), cfg))
    df = add_valuation_ranks(df, cfg).withColumn("value_factor_raw", F.col("value_score"))
    return add_multifactor(add_factor_scores(add_candidate_score(df, cfg)))
