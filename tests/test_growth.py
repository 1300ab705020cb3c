"""What must not grow faster than the input: rows that travel, rows that are kept, rows that are ranked."""

import datetime as dt
import random
import re

import pandas as pd
import pytest
from conftest import SMALL
from ticklane import config as cf
from ticklane.functions import indicators as ind
from ticklane.operators import backtest as bt
from ticklane.operators import ml
from ticklane.operators import portfolio as pf
from ticklane.operators import signals as sg
from ticklane.operators import similarity
from ticklane.plans import ml_queries as mq
from ticklane.plans import portfolio_queries as pq
from ticklane.plans import signal_queries as sq
from ticklane.plans import trade_queries as tq
from ticklane.sources.bars import bars_from_lineitem

DAY0 = dt.date(2024, 1, 1)


def exchanges(frame, key: str) -> int:
    text = frame._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"Exchange hashpartitioning\({key}#\d+L?,", text))


def test_panel_rows_travel_once_to_their_days(spark):
    bars = bars_from_lineitem(spark, SMALL)
    panel = sg.factor_panel(bars, own=pf.own_columns()).withColumns(pf.day_columns()).select(*pq._READ)
    assert exchanges(panel, "date") <= 2  # the days of the panel, and of the market's state
    assert exchanges(sg.signal_panel(bars).select("code", "date", "s2_entry", "s2_stop"), "date") <= 1


def test_line_items_travel_once_to_their_codes(spark):
    text = bars_from_lineitem(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == exchanges(bars_from_lineitem(spark, SMALL), "code") == 1


def test_ledger_rows_stay_with_their_codes(spark):
    """The trades' fold reads signals that went to no day: one exchange by date, of the market's state."""
    assert exchanges(tq.ledger(spark, SMALL).select("code", "pnl_pct"), "date") <= 1


def test_tops_by_steps_equal_a_ranking(spark):
    """Ties, nulls and days with fewer rows than places; every day's top rows and the number of its candidates."""
    rng = random.Random(3)
    rows = []
    for k in range(12):
        for c in range(rng.choice([1, 2, 40])):
            score = rng.choice([None, 55.0, 60.0, 60.04, round(rng.uniform(40, 100), 2)])
            rows.append((c, DAY0 + dt.timedelta(days=k), c * 100 + k, score, rng.choice([None, 1.0, 2.0]), 1.0, rng.choice(["trend_ok", "neutral", None]), "why", rng.random() < 0.3))
    frame = spark.createDataFrame(rows, "code long, date date, rn int, profile_score_blended double, candidate_score double, technical_score double, market_state_index string, composite_reason string, signal boolean")
    p = cf.Portfolio(top_n=3, min_score=55.0)
    top, days = pf.tops(frame, {"a": p})
    df = pd.DataFrame(rows, columns=frame.columns)
    df = df[df["market_state_index"].notna() & (df["signal"] | (df["profile_score_blended"] >= 55))]
    ranked = df.sort_values(["date", "profile_score_blended", "candidate_score", "technical_score", "code"], ascending=[True, False, False, False, True], na_position="last").groupby("date").head(3)
    assert sorted((r.date, r.code) for r in top.collect()) == sorted(zip(ranked["date"], ranked["code"], strict=True))
    assert {r.date: r.day_candidates for r in days.collect()} == df.groupby("date").size().to_dict()


def test_risk_sim_folds_rows_near_the_top_only(spark, monkeypatch):
    """Every code is on top once, as in large tables: what is folded are the few days around it, and the result is that of all rows."""
    n, codes = 60, 60
    rows = [(DAY0 + dt.timedelta(days=k), c, 10.0 + (c * 7 + k * 3) % 11, 0.05 if c in (k, (k + 1) % codes) else -0.01, -0.09 if (c + k) % 13 == 0 else -0.03, "v") for k in range(n) for c in range(codes) if (c * 5 + k * 2) % 6]
    preds = spark.createDataFrame(rows, "date date, code long, open double, pred_ret double, pred_mae double, variant string")
    few = bt.risk_budget_sim(preds).orderBy("date_open").collect()
    folded = []
    whole = bt._holdable
    monkeypatch.setattr(bt, "_holdable", lambda rows, by: folded.append(whole(rows, by).count()) or rows.drop("_k"))
    every = bt.risk_budget_sim(preds).orderBy("date_open").collect()
    assert few == every and folded[0] < len(rows) / 5 and any(r.n_positions for r in few)


def test_train_report_keeps_the_rows_it_uses(spark, monkeypatch):
    class Enough(Exception):
        pass

    def enough(frame, *_, **__):
        raise Enough

    kept, real = {}, tq.kept
    monkeypatch.setattr(tq, "kept", lambda s, df, label: kept.setdefault(label, real(s, df, label)))
    monkeypatch.setattr(mq.tr, "train_and_report", enough)
    with pytest.raises(Enough):
        mq.train_report(spark, SMALL)
    assert 0 < kept["panel"].count() < bars_from_lineitem(spark, SMALL).count() / 3


def test_trials_share_a_codes_windows_and_bars(spark, monkeypatch):
    """What travels a trial are the days on which it enters or raises a stop, and no window is made after rows met the trials."""
    seen = {}
    monkeypatch.setattr(bt, "trial_trades", lambda bars, busy, cfg: seen.update(bars=bars, busy=busy) or busy)
    bars = bars_from_lineitem(spark, SMALL)
    panel = sg.add_windows(sg.add_valuation(ind.add_panel(bars)))
    ml.trial_ledgers(panel, sg.market_state(panel), ml.sample_configs(6))
    assert 0 < seen["busy"].count() < 6 * seen["bars"].count() / 3
    plan = seen["busy"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Join Inner")]


def test_tuning_writes_no_panel(spark, monkeypatch):
    """What is kept are the market's state and trades; bars and trials' days go to their codes in one exchange, and to no day."""
    kept, real = {}, tq.kept
    monkeypatch.setattr(tq, "kept", lambda s, df, label: kept.setdefault(label, (df, real(s, df, label)))[1])
    mq._tuned(spark, SMALL, {"baseline": cf.VALUATION_VARIANTS["baseline"]})
    assert set(kept) == {"state", "trials"}
    assert exchanges(kept["trials"][0], "date") == 0 and exchanges(kept["trials"][0], "code") == 2  # line items, bars with trials


def test_an_index_of_windows_has_no_copy_of_their_vectors(spark):
    rows = [(k % 3, DAY0 + dt.timedelta(days=k), DAY0 + dt.timedelta(days=k + 6), [float(k), float(k * k % 7)] * 10, 5) for k in range(60)]
    index = similarity.build_index(spark.createDataFrame(rows, "code long, start_date date, end_date date, vec array<double>, future_days long"))
    assert sorted(index.table.columns) == ["cell", "code", "end_date", "sketch", "start_date"] and index.table.count() == 60


def test_no_row_travels_behind_the_fold_of_recursive_indicators(spark):
    bars = bars_from_lineitem(spark, SMALL)
    for made in (sg.own_signals(bars, cf.DEFAULT, sg.RECURSIVE, ()), mq.ind.add_panel(mq.lb.ret_mae(bars)), tq._entries(spark, SMALL)):
        text = made._jdf.queryExecution().executedPlan().toString()
        behind = text[: text.index("FlatMapGroupsInArrow")]
        assert not re.search(r"Exchange hashpartitioning\(code", behind)


def test_a_signal_without_recursive_indicators_runs_no_python(spark):
    text = sq.QUERIES["s2_signal"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in text


def test_the_values_of_a_window_are_collected_once(spark):
    frame = spark.createDataFrame([(1, DAY0, 1.0)], "code long, date date, x double")
    assert ind.add_pct_ranks(frame, 5, r="x")._jdf.queryExecution().executedPlan().toString().count("collect_list(") == 1
