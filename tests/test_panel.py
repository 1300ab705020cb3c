"""Micro fixtures: nulls, warm-up, ties, exits, patterns, prefix stability."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from ticklane import config as cf
from ticklane.functions import indicators as ind
from ticklane.functions.base import sma
from ticklane.operators import backtest as bt
from ticklane.operators import buckets, labels, metrics, ml, patterns, portfolio
from ticklane.operators import signals as sg
from ticklane.sources import bars as src
from ticklane.streaming import incremental as inc

DAY0 = dt.date(2024, 1, 1)


def days(n, start=0):
    return [DAY0 + dt.timedelta(days=i + start) for i in range(n)]


def frame(spark, close, code="a", **more):
    n = len(close)
    data = {"code": [code] * n, "date": days(n), "open": close, "high": [None if x is None else x * 1.01 for x in close], "low": [None if x is None else x * 0.99 for x in close], "close": close, "volume": [100.0] * n} | more
    rows = list(zip(*data.values(), strict=True))
    kinds = {"code": "string", "date": "date"}
    return spark.createDataFrame(rows, ", ".join(f"{k} {kinds.get(k, 'double')}" for k in data))


def column(df, name):
    return [r[name] for r in df.orderBy("code", "date").select(name).collect()]


def walk(n, seed=1):
    return (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))).tolist()


@pytest.mark.parametrize(("alpha", "least"), [(2 / 13, 12), (1 / 3, 9), (2 / 201, 200)])
def test_ewm_equals_pandas(spark, alpha, least):
    x = [None] * 3 + walk(700)
    got = column(ind.add_ewm(frame(spark, x), "close", "y", alpha, least), "y")
    want = pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
    assert np.allclose(np.array(got, float), want, rtol=1e-9, equal_nan=True)


def test_ewm_of_a_long_series_does_not_overflow(spark):
    x = walk(4000)
    got = column(ind.add_ewm(frame(spark, x), "close", "y", 1 / 3, 1), "y")
    assert np.allclose(got, pd.Series(x).ewm(alpha=1 / 3, adjust=False).mean(), rtol=1e-9)


def test_ewm_with_gaps(spark):
    x = walk(60)
    x[20] = x[21] = None
    got = column(ind.ewm_with_gaps(frame(spark, x), "close", "y", 0.2, 5), "y")
    assert np.allclose(np.array(got, float), pd.Series(x, dtype=float).ewm(alpha=0.2, adjust=False, min_periods=5).mean(), equal_nan=True)


def test_flat_then_up(spark):
    df = frame(spark, [10.0] * 20 + [10.0 + i for i in range(20)])
    assert column(ind.add_rsi(df), "rsi14")[-1] is None  # nothing lost
    assert column(ind.add_obv(df), "obv")[0] == 0
    flat = frame(spark, [10.0] * 5, high=[10.0] * 5, low=[10.0] * 5)
    assert column(flat.withColumn("x", ind.clv()), "x") == [0.0] * 5


def test_null_inside_a_window(spark):
    x = walk(60)
    x[30] = None
    got = column(frame(spark, x).withColumn("s", sma("close", 10)), "s")
    assert [i for i, v in enumerate(got) if v is None] == [*range(9), *range(30, 40)]


def test_short_history_has_no_indicators(spark):
    row = ind.add_panel(frame(spark, walk(12))).orderBy(F.desc("date")).first()
    assert row.ema20 is None and row.atr14 is None and row.adx14 is None and row.boll_mid is None


def test_psar_flips():
    up, down = [10 + i for i in range(12)], [21 - 2 * i for i in range(12)]
    close = up + down + [0 + 3 * i for i in range(10)]
    got = list(ind.stops([x + 0.5 for x in close], [x - 0.5 for x in close]))
    side = ["long" if s <= c else "short" for s, c in zip(got, close, strict=True)]
    assert side[5] == "long" and side[20] == "short" and side[-1] == "long" and got[0] == close[0] - 0.5


def test_causal_columns_do_not_change_when_later_rows_go(spark):
    x = walk(260)
    cols = ["ema20", "macd_hist", "rsi14", "adx14", "boll_bw", "cci20", "kdj_d", "psar", "mdd60", "obv"]
    whole = ind.add_panel(frame(spark, x)).orderBy("date").limit(230).select(cols).toPandas()
    part = ind.add_panel(frame(spark, x[:230])).orderBy("date").select(cols).toPandas()
    pd.testing.assert_frame_equal(whole, part)


def test_rank_ties(spark):
    rows = [("abcdefg"[i], DAY0, v) for i, v in enumerate([3.0, 1.0, 1.0, 2.0, None, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "code string, date date, x double").withColumn("r", sg.cs_rank("x"))
    got = [r.r for r in df.orderBy("code").collect()]
    assert [None if v is None else round(v, 4) for v in got] == [1.0, 0.25, 0.25, 0.6667, None, 0.6667, 0.6667]


def test_qcut_sizes(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "code int, v double")
    assert [r["count"] for r in buckets.qcut(df, "v", 3, tie=["code"]).groupBy("bin").count().orderBy("bin").collect()] == [4, 3, 4]


def test_mode_tie_takes_the_smaller(spark):
    df = spark.createDataFrame([("trend_ok",), ("neutral",)], "s string")
    assert df.agg(F.mode("s", deterministic=True)).first()[0] == "neutral"


def test_union_dedup_newest_file_wins(spark):
    old = spark.createDataFrame([("a", DAY0, 1.0), ("b", DAY0, 2.0)], "code string, date date, close double")
    new = spark.createDataFrame([("a", DAY0, 9.0)], "code string, date date, close double")
    assert {(r.code, r.close) for r in src.union_dedup([old, new]).collect()} == {("a", 9.0), ("b", 2.0)}
    assert {(r.code, r.close) for r in inc.upsert(old, new, ["code", "date"]).collect()} == {("a", 9.0), ("b", 2.0)}


def test_norm_code(spark):
    df = spark.createDataFrame([("sh.600000",), (" 1 ",), ("abc",), ("12345678",), (None,)], "x string")
    assert [r[0] for r in df.select(src.norm_code(F.col("x"))).collect()] == ["600000", "000001", None, "12345678", None]


def test_auto_columns_reports_what_is_missing(spark):
    with pytest.raises(ValueError, match="close"):
        src.auto_columns(spark.createDataFrame([(1, 2)], "code int, date int"))


def signal_rows(spark, n=30, **over):
    base = {
        "code": ["a"] * n, "date": days(n), "open": [10.0 + i for i in range(n)], "close": [10.5 + i for i in range(n)], "ema20": [9.0] * n, "ema50": [5.0] * n, "boll_mid": [5.0] * n, "macd_dif": [2.0] * n,
        "macd_dea": [1.0] * n, "psar": [4.0] * n, "market_state_index": ["trend_ok"] * n, "market_state_stock": ["trend"] * n, "s1_entry": [0] * n, "s1_stop": [1.0] * n, "s1_pos": [0.1] * n, "s2_entry": [0] * n,
        "s2_stop": [1.0] * n, "s2_pos": [0.1] * n, "s3_long_entry": [0] * n, "s3_stop": [1.0] * n, "s3_pos": [0.1] * n, "s4_pyramid": [0] * n, "adx14": [30.0] * n, "value_score": [None] * n, "pb_cs_rank": [None] * n,
        "ps_cs_rank": [None] * n,
    }
    for k, v in over.items():
        for i, x in v.items():
            base[k][i] = x
    kinds = {"code": "string", "date": "date", "market_state_index": "string", "market_state_stock": "string"} | {k: "int" for k in ("s1_entry", "s2_entry", "s3_long_entry", "s4_pyramid")}
    return spark.createDataFrame(list(zip(*base.values(), strict=True)), ", ".join(f"{k} {kinds.get(k, 'double')}" for k in base))


EXITS = {
    "hit_stop": ({"s2_entry": {2: 1}, "close": {6: 0.5}}, "S2", 7),
    "s1_macd_dead": ({"s1_entry": {2: 1}, "macd_dif": dict.fromkeys(range(6, 30), 0.5)}, "S1", 7),
    "s1_ema50": ({"s1_entry": {2: 1}, "ema50": {6: 99.0}}, "S1", 7),
    "s2_midband": ({"s2_entry": {2: 1}, "boll_mid": {6: 99.0}}, "S2", 7),
    "eod_close": ({"s2_entry": {2: 1}}, "S2", 29),
}
REASON = {"hit_stop": "hit_stop", "s1_macd_dead": "ema50_break or macd_dead", "s1_ema50": "ema50_break or macd_dead", "s2_midband": "midband_fail", "eod_close": "eod_close"}


@pytest.mark.parametrize("name", sorted(EXITS))
def test_ledger_exits(spark, name):
    over, strategy, at = EXITS[name]
    (row,) = bt.backtest_ledger(signal_rows(spark, **over)).collect()
    assert (row.strategy, row.exit_reason, row.entry_date, row.exit_date, row.entry_price) == (strategy, REASON[name], days(30)[2], days(30)[at], 13.0)


def test_ledger_reversion_exit(spark):
    over = {"s3_long_entry": {2: 1}, "market_state_stock": {2: "range"}, "boll_mid": {i: 99.0 for i in range(6)}}
    (row,) = bt.backtest_ledger(signal_rows(spark, **over)).collect()
    assert row.exit_reason == "mean_revert_tp" and row.exit_date == days(30)[7]


def test_ledger_leaves_and_enters_on_one_open(spark):
    rows = bt.backtest_ledger(signal_rows(spark, s2_entry={2: 1, 6: 1}, close={6: 0.5})).orderBy("signal_date").collect()
    assert [r.signal_date for r in rows] == [days(30)[2], days(30)[6]] and rows[0].exit_price == rows[1].entry_price


def test_ledger_stop_is_raised_on_pyramid_days(spark):
    (row,) = bt.backtest_ledger(signal_rows(spark, s2_entry={2: 1}, s4_pyramid={4: 1}, psar={4: 12.0}, close={8: 11.0})).collect()
    assert row.exit_reason == "hit_stop" and row.stop_on_exit == 12.0 and row.initial_stop == 1.0


def test_virtual_trades_overlap(spark):
    rows = signal_rows(spark, s2_entry={2: 1, 3: 1})
    assert bt.virtual_trades(rows).count() == 2 and bt.backtest_ledger(rows).count() == 1
    (zero,) = bt.virtual_trades(signal_rows(spark, s2_entry={2: 1}, boll_mid={2: 99.0})).collect()
    assert zero.entry_date == zero.exit_date and abs(zero.pnl_pct + 0.0004) < 1e-12


def position(**over):
    return {"days": 8, "score": 70.0, "price": 10.0, "peak": 10.0, "weight": 0.2} | over


def bar(**over):
    row = {"close": 10.0, "ema20": 9.0, "ema50": 8.0, "adx14": 30.0, "dist_high20": -0.01, "atr_pct": 0.02, "multifactor_score": 70.0, "rank_today": 1.0, "stop": 1.0, "signal": True} | over
    under, falling = row["close"] < row["ema20"], row["ema20"] < row["ema50"]
    return row | {"under": under, "breakdown": under and falling or under and row["dist_high20"] < -0.12 or falling and row["adx14"] < 16}


@pytest.mark.parametrize(
    ("style", "pos", "row", "want"),
    [
        ("rank", {}, {"close": 0.5}, "hit_stop"), ("rank", {"days": 20}, {}, "max_hold"), ("rank", {"days": 3}, {"multifactor_score": 1.0}, None), ("rank", {}, {"rank_today": 50.0, "multifactor_score": 50.0}, "rank_drop"),
        ("rank", {}, {"multifactor_score": 50.0}, "score_fade"), ("rank", {"score": 60.0}, {"multifactor_score": 54.0, "signal": False}, "signal_off"), ("rank", {}, {"ema20": 11.0, "ema50": 12.0}, "trend_break"),
        ("rank", {"peak": 12.0}, {"ema20": 11.0}, "trail_exit"), ("score", {"peak": 12.0}, {"ema20": 11.0, "multifactor_score": 50.0}, "score_fade"), ("trend", {"peak": 12.0}, {"ema20": 11.0, "ema50": 12.0}, "trend_break"),
    ],
)
def test_portfolio_exit_ladders(style, pos, row, want):
    assert portfolio._exit(position(**pos), bar(**row), False, cf.Portfolio(exit_style=style)) == want


def test_allocation_bounds():
    p = cf.Portfolio()
    weights = portfolio.allocate([90.0, 60.0, 56.0], 0.7, p)
    assert all(w <= p.max_position_weight for w in weights) and weights[0] >= weights[1] >= weights[2] > 0
    assert portfolio.allocate([], 0.5, p) == [] and portfolio.allocate([90.0], 0.0, p) == [0.0]


def tight_flag(hold=True):
    close = [100.0] * 21 + [106.0, 106.2] + [106.1] * 3 + [108.5, 108.6 if hold else 90.0, 108.6]
    n = len(close)
    opened = [100.0] * 21 + [100.5, 106.1] + [106.1] * 3 + [106.5, 108.5, 108.5]
    high = [x * 1.002 for x in close]
    low = [min(o, x) * 0.999 for o, x in zip(opened, close, strict=True)]
    volume = [100.0] * 21 + [250.0, 120.0] + [60.0] * 3 + [260.0, 100.0, 100.0]
    return close, {"open": opened, "high": high, "low": low, "volume": volume}, n


@pytest.mark.parametrize("hold", [True, False])
def test_high_tight_flag(spark, hold):
    close, more, _ = tight_flag(hold)
    df = ind.add_pattern_basics(frame(spark, close, **more))
    found = patterns.high_tight_flag(df, patterns.Flag(day0_ret=0.05)).collect()
    assert [(r.bar_index, r.entry_index, r.flag_n) for r in found] == ([(21, 27, 3)] if hold else [])


@pytest.mark.parametrize(("day", "fires"), [(1, True), (2, True), (3, True), (4, False)])
def test_false_breakdown_reclaim(spark, day, fires):
    close = [100.0] * 25 + [95.0] * 6
    for k in range(25 + day, 31):
        close[k] = 101.0
    low = [99.0] * 25 + [94.0] * 6
    df = ind.add_pattern_basics(frame(spark, close, low=low, volume=[100.0] * 25 + [50.0] * 6))
    hits = [r for r in patterns.false_breakdown(df).collect() if r.bar_index == 25]
    assert bool(hits) is fires and (not fires or hits[0].entry_index == 25 + day)


def test_barriers_on_one_day_are_sideways(spark):
    close = [100.0] * 25
    high, low = [100.0] * 25, [100.0] * 25
    high[3], low[3] = 120.0, 80.0
    got = column(labels.triple_barrier(frame(spark, close, high=high, low=low)), "label")
    assert got[0] == 1 and got[-1] is None and got[10] == 1


def test_labels_look_ahead(spark):
    x = walk(60)
    whole = column(labels.future_close(frame(spark, x)).limit(50), "close_t1")
    part = column(labels.future_close(frame(spark, x[:50])), "close_t1")
    assert whole[49] is not None and part[49] is None


def test_walk_windows(spark):
    rows = labels.walk_windows(spark, dt.date(2020, 1, 31), dt.date(2022, 1, 1)).collect()
    assert rows[0].val_start == dt.date(2021, 1, 31) and rows[0].test_start == dt.date(2021, 4, 30) and all(r.test_end <= dt.date(2022, 1, 1) for r in rows)


def test_threshold_scan_is_consistent(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, prob double")
    for r in metrics.threshold_scan(df).collect():
        hit = p >= r.threshold - 1e-9
        assert (r.tp, r.fp, r.fn, r.tn) == (int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum()), int((~hit & (y == 1)).sum()), int((~hit & (y == 0)).sum()))
        assert math.isclose(r.precision, r.tp / r.pred_pos if r.pred_pos else 0.0, abs_tol=1e-9)
    assert metrics.best_threshold(metrics.threshold_scan(df)).first().f1 >= 0.6



def test_top_prefix_stops_at_the_budget(spark):
    rows = [("a", DAY0, 0.05, -0.05), ("b", DAY0, 0.04, -0.05), ("c", DAY0, 0.03, -0.05), ("d", DAY0, 0.001, -0.01)]
    df = bt.add_risk(spark.createDataFrame(rows, "code string, date date, pred_ret double, pred_mae double"))
    assert [r.code for r in bt.top_prefix(bt.candidate_pool(df)).orderBy("place").collect()] == ["a", "b"]


def test_config_merge():
    c = cf.DEFAULT.merged({"s1": {"atr_mul": 2.0}, "cost_bp": 5.0})
    assert c.s1.atr_mul == 2.0 and c.s1.rsi_bull_low == cf.DEFAULT.s1.rsi_bull_low and c.cost_bp == 5.0
    with pytest.raises(KeyError):
        cf.DEFAULT.merged({"windows": {}})


def test_variant_sets_have_the_styles_and_profiles():
    every = {name: list(some) for name, some in cf.VARIANT_SETS.items()}
    assert [len(every[k]) for k in ("full", "combo_compare", "meta_compare", "regime_compare", "pullback_compare", "pullback_exit_compare", "pullback_opt_compare")] == [13, 3, 4, 4, 3, 3, 2]
    assert {p.exit_style for p in cf.VARIANT_SETS["pullback_exit_compare"].values()} == {"rank", "score", "trend"}
    assert {p.strategy_profile for k in ("meta_compare", "regime_compare") for p in cf.VARIANT_SETS[k].values()} >= {"meta_switch_rsi_vol", "regime_switch"}


def history(spark, rows):
    return spark.createDataFrame(rows, "window int, best_variant string, label_score double, fallback string, x double, y double")


def brute_pick(rows, i, k=5, least=6):
    """The vote of the nearest earlier windows in plain Python."""
    window, _, _, fallback, *mine = rows[i]
    past = [r for r in rows if r[0] < window]
    if len(past) < least:
        return fallback
    total = np.zeros(len(past))
    for f in (4, 5):
        values = np.array([np.nan if r[f] is None else r[f] for r in past])
        middle = np.nanmedian(values)
        spread = np.nanquantile(values, 0.75) - np.nanquantile(values, 0.25)
        z = np.nan_to_num((values - middle) / (spread or 1.0))
        total += (z - (mine[f - 4] - middle) / (spread or 1.0)) ** 2
    near = sorted(zip(np.sqrt(total), [-r[2] for r in past], range(len(past)), strict=True))[:k]
    votes = {}
    for d, _, j in near:
        votes[past[j][1]] = votes.get(past[j][1], 0.0) + 1 / max(d, 0.05)
    return max(votes.items(), key=lambda kv: kv[1])[0]


def test_meta_pick_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "abc"[int(rng.integers(3))], float(rng.integers(5)), "f", float(rng.integers(4)), None if k == 3 else float(rng.normal())) for k in range(25)]
    rows[10] = (10, "a", 9.0, "f", rows[4][4], rows[4][5])  # an exact repeat does not outvote everything: 1 / 0.05
    got = {r.window: r.picked for r in portfolio.meta_pick(history(spark, rows), ["x", "y"]).collect()}
    assert got == {r[0]: brute_pick(rows, i) for i, r in enumerate(rows)}


def test_regime_summary_order_and_means(spark):
    rows = [("r", 1, "a", 0, 0.5, 0.01, 10, 5.0, 60.0), ("r", 1, "b", 1, 0.6, 0.02, 20, 6.0, 60.0), ("r", 2, "a", 0, 0.7, 0.03, 30, 7.0, 50.0), ("r", 2, "b", 1, 0.4, 0.00, 40, 8.0, 55.0), ("q", 3, "b", 1, 0.1, 0.5, 1, 1.0, 9.0), ("q", 3, "a", 0, None, None, 0, None, -1e9)]
    df = spark.createDataFrame(rows, "regime string, window_id int, variant string, variant_no int, hit_rate double, expectancy double, trade_count long, avg_hold_days double, score double")
    got = [(r.regime, r.variant, r.win_count, r.avg_hold_days, r.score) for r in portfolio.regime_summary(df).collect()]
    # of equal scores in window 1 the variant named first wins
    assert got == [("q", "b", 1, 1.0, 9.0), ("q", "a", 0, None, -1e9), ("r", "a", 1, 6.0, 55.0), ("r", "b", 1, 7.0, 57.5)]


def test_net_actions_prefer_the_candidates_weight(spark):
    held = spark.createDataFrame([("a", DAY0, 10.0, 60.0, 0.2, "S1", 4), ("b", DAY0, 0.0, 60.0, 0.1, "S2", 4)], "code string, entry_date date, entry_price double, entry_score double, weight double, strategy string, days_held int")
    top = spark.createDataFrame([("a", 1, 0.3, "S3", 11.0, "x"), ("c", 2, 0.25, "MF", 5.0, "why"), ("d", 3, 0.2, "S1", 6.0, "z")], "code string, place int, target_weight double, strategy string, close double, reason string")
    last = spark.createDataFrame([("a", 12.0)], "code string, close double")
    got = [tuple(r) for r in portfolio.net_actions(held, top, last, 3).collect()]
    assert got == [("a", "HOLD", 0.3, "S3", DAY0, 10.0, 12.0, pytest.approx(0.2), "existing_position_hold"), ("b", "HOLD", 0.1, "S2", DAY0, 0.0, None, None, "existing_position_hold"), ("c", "BUY", 0.25, "MF", None, None, 5.0, None, "why")]
    orders = spark.createDataFrame([(DAY0, DAY0 + dt.timedelta(days=k), "a", side, 1.0, 0.1, 50.0, "S1", "r") for k, side in ((1, "BUY"), (3, "SELL"), (3, "BUY"), (9, "BUY"))], "signal_date date, execute_date date, code string, side string, price double, weight double, score double, strategy string, reason string")
    trades = spark.createDataFrame([("a", DAY0, DAY0 + dt.timedelta(days=3), 0.5)], "code string, entry_date date, exit_date date, pnl_pct double")
    rows = portfolio.action_history(orders, trades, portfolio.net_actions(held, top, last, 3), DAY0 + dt.timedelta(days=4), recent_days=2).collect()
    assert [(r.action_date.day - DAY0.day, r.action, r.code, r.pnl_pct) for r in rows] == [(4, "HOLD", "a", pytest.approx(0.2)), (4, "HOLD", "b", None), (3, "SELL", "a", 0.5), (3, "BUY", "a", None)]


def test_risk_sim_counts_days_without_a_top_code(spark):
    at = [DAY0 + dt.timedelta(days=k) for k in range(6)]
    rows = [("v", at[k], "a", 10.0 + k, 0.05 if k < 2 else -1.0, -0.05) for k in (0, 1, 2, 4, 5)] + [("v", d, "z", 1.0, -1.0, -0.05) for d in at]
    got = bt.risk_budget_sim(spark.createDataFrame(rows, "variant string, date date, code string, open double, pred_ret double, pred_mae double")).orderBy("date_open").collect()
    # day 3, on which "a" has no bar, is its second day outside: it leaves at the next open
    assert [(r.date_open, r.n_positions, r.sells) for r in got] == [(at[1], 1, 0), (at[2], 1, 0), (at[3], 1, 0), (at[4], 0, 1)]


def test_events_without_an_entry_day_are_left_out(spark):
    close = [100.0 + 0.3 * k for k in range(40)]
    found = patterns.scan(frame(spark, close, volume=[100.0 + k for k in range(40)]))
    assert found.where("entry_date IS NULL").count() == 0 and found.count() > 0


def brute_holdings(days, p, cost):
    """Trades of a portfolio in plain Python: days maps a date to (next date, exposure, {code: bar}, top codes in order)."""
    held, out = {}, []
    for date, (after, exposure, bars_, top) in days.items():
        if after is None:
            continue
        for code in list(held):
            pos, row = held[code], bars_.get(code)
            if row is None:
                continue
            pos["days"] += 1
            pos["peak"] = max(pos["peak"], row["close"])
            why = portfolio._exit(pos, row, code in top, p)
            if why and row["next_open"] is not None:
                out.append((code, pos["date"], after, why, round((row["next_open"] - pos["price"]) / pos["price"] - cost, 9)))
                del held[code]
        room = max(0.0, exposure - sum(x["weight"] for x in held.values()))
        fresh = [c for c in top if c not in held][: max(0, p.top_n - len(held))]
        for code, weight in zip(fresh, portfolio.allocate([bars_[c]["strategy_score"] for c in fresh], room, p), strict=True):
            if bars_[code]["next_open"] is not None and weight > 0:
                held[code] = {"date": after, "price": bars_[code]["next_open"], "score": bars_[code]["strategy_score"], "weight": weight, "peak": bars_[code]["close"], "days": 0}
    return out


def test_holding_without_a_bar_keeps_its_age(spark):
    """A held code without a bar on a day: its days held stay as they are."""
    p = cf.Portfolio(max_hold_days=3, min_hold_days=1)
    at = [DAY0 + dt.timedelta(days=k) for k in range(9)]
    rows = []
    for k, d in enumerate(at):
        for code in "ab":
            if not (code == "a" and k in (2, 3)):
                rows.append({"date": d, "code": code, "day_next": at[k + 1] if k < 8 else None, "day_exposure": 0.5, "day_candidates": 1, "close": 10.0 + k, "atr_pct": 0.02, "multifactor_score": 70.0, "rank_today": 1.0, "stop": 1.0,
                             "next_open": 10.5 + k if k < 8 else None, "place": 1.0 if code == "a" and k == 0 else None, "strategy_score": 70.0, "signal": True, "breakdown": False, "under": False, "strategy": "MF", "reason": ""})
    import pandas as pd

    events = portfolio._fold(pd.DataFrame(rows).sort_values(["date", "code"]), p, 0.0004)
    (trade,) = [e for e in events if e["kind"] == "trade"]
    assert (trade["entry_date"], trade["exit_date"], trade["days_held"], trade["reason"]) == (at[1], at[6], 3, "max_hold")
    days_ = {d: (at[k + 1] if k < 8 else None, 0.5, {r["code"]: r for r in rows if r["date"] == d}, ["a"] if k == 0 else []) for k, d in enumerate(at)}
    assert brute_holdings(days_, p, 0.0004) == [("a", at[1], at[6], "max_hold", round(trade["pnl_pct"], 9))]


# Rows of a published threshold scan (threshold, precision, recall, f1, tp, fp, tn, fn).
SCAN = [(0.0, 0.0, 0.0, 0.0, 0, 0, 10, 0), (0.5, 0.01839, 0.76188, 0.03591, None, None, None, None), (0.84, 0.14286, 0.17366, 0.15676, None, None, None, None)]


def test_scan_vector_is_consistent():
    for _, precision, recall, f1, *_ in SCAN[1:]:
        assert math.isclose(2 * precision * recall / (precision + recall), f1, abs_tol=2e-5)


def test_trials_in_one_pass_equal_trials_one_by_one(spark):
    from ticklane.operators import signals as sg
    from ticklane.sources.bars import bars_from_lineitem

    panel = sg.add_valuation(ind.add_panel(bars_from_lineitem(spark, "/root/testdata/sf0.001"))).cache()
    state = sg.market_state(panel).cache()
    configs = ml.sample_configs(3)
    keys = ["code", "strategy", "entry_date", "exit_date", "exit_reason", "pnl_pct"]
    got = ml.trial_ledgers(panel, state, configs).select("trial", *keys).collect()
    want = [(k, *r) for k, c in enumerate(configs) for r in bt.backtest_ledger(sg.assemble(panel, state, c), c).select(*keys).collect()]
    assert sorted(map(tuple, got)) == sorted(want) and len({r.trial for r in got}) == 3


def test_trials_of_two_ways_equal_ledgers_one_by_one(spark):
    """Filtered and not in one pass: every column of the trades; and a trial's days reach their code as few cells."""
    from ticklane import config as cf
    from ticklane.operators import signals as sg
    from ticklane.sources.bars import bars_from_lineitem

    panel = sg.add_valuation(ind.add_panel(bars_from_lineitem(spark, "/root/testdata/sf0.001").where("code < 4"))).cache()
    state = sg.market_state(panel).cache()
    configs = ml.sample_configs(2)
    ways = tuple(cf.DEFAULT.merged({"valuation": {"enabled": on, "mode": "soft_filter", "expensive_cut": 0.6}}) for on in (False, True))
    got = ml.trial_ledgers(panel, state, configs, cf.DEFAULT, ways)
    names = [x for x in got.columns if x not in ("way", "trial")]
    want = []
    for k, way in enumerate(ways):
        for t, c in enumerate(configs):
            signals = sg.assemble(panel, state, c)
            want += [(k, t, *r) for r in bt.backtest_ledger(signals, c.merged({"valuation": {"enabled": way.valuation.enabled, "mode": "soft_filter", "expensive_cut": 0.6}})).select(*names).collect()]
    plain = lambda rows: sorted(repr([None if x != x else x for x in r]) for r in rows)
    assert plain(got.select("way", "trial", *names).collect()) == plain(want) and {r[0] for r in want} == {0, 1} and plain(r for r in want if r[0]) != plain((1, *r[1:]) for r in want if not r[0])
    # without valuation, trades have none, and nothing else differs
    few = ml.trial_ledgers(panel.drop("value_score"), state, configs, cf.DEFAULT, ways)
    assert few.where("value_score IS NOT NULL").count() == 0 and few.count() == len(want)
    # of a panel that is read once
    once = ml.ledgers_in_one_pass(sg.add_windows(panel).withColumn("_rn", F.row_number().over(W.partitionBy("code").orderBy("date"))), state, configs, ways)
    some = ["way", "trial", *[x for x in names if x not in bt.VALUES]]
    assert plain(once.select(*some).collect()) == plain(got.select(*some).collect())


def test_tuning_takes_the_best_trial_of_each_bucket(spark):
    day = lambda k: DAY0 + dt.timedelta(days=k)
    trades = spark.createDataFrame([(t, c, day(k), day(k + 2), p) for t, c, k, p in [(0, "a", 5, 0.1), (1, "a", 5, 0.3), (0, "b", 5, 0.2), (1, "b", 5, -0.2), (1, "b", 50, 9.0), (0, "b", 12, 0.5), (1, "a", 12, 0.4), (0, "a", 12, -0.4)]], "trial int, code string, entry_date date, exit_date date, pnl_pct double")
    cut = spark.createDataFrame([("a", 0), ("b", 1)], "code string, bucket_id int")
    windows = spark.createDataFrame([(0, day(0), day(0), day(10), day(20)), (1, day(20), day(20), day(30), day(40))], "window_id int, train_start date, val_start date, test_start date, test_end date")
    tuned = ml.tune(trades, cut, windows, 2)
    assert {(r.window_id, r.bucket_id): (r.trial, r.trade_count) for r in tuned.collect()} == {(0, 0): (1, 1), (0, 1): (0, 1), (1, 0): (0, 0), (1, 1): (0, 0)}
    out = {(r.window_id, r.variant): (r.trade_count, r.expectancy) for r in ml.tuned_walk_forward({"x": trades}, tuned, cut, windows).collect()}
    assert out == {(0, "x"): (2, pytest.approx(0.45)), (1, "x"): (0, None)}
