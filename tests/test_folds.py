"""Panels in folds: the same doubles as windows, and no window's work a row."""

import re

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from ticklane import config as cf
from ticklane.functions import folds as fd
from ticklane.functions import indicators as ind
from ticklane.operators import signals as sg
from ticklane.plans import signal_queries as sq
from ticklane.sources.bars import bars_from_lineitem


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_signals_make_no_sliding_window(spark):
    for made in (sg.own_signals(bars_from_lineitem(spark, SMALL), cf.DEFAULT, sg.RECURSIVE, ()), ind.add_panel_v2(bars_from_lineitem(spark, SMALL))):
        assert not re.search(r"RowFrame, -(13|19|59)", plan(made))


def test_a_days_ranks_do_not_sort_the_day_again_and_again(spark):
    assert len(re.findall(r"Sort \[date#", plan(sq.QUERIES["rank_today"](spark, SMALL)))) <= 3  # the median's fold, the ranks' fold, the numbers


def test_folded_panel_equals_windows(spark):
    bars = bars_from_lineitem(spark, SMALL)
    rows = sg.add_windows(ind.add_panel(bars, ())).select("code", "date", *ind.ROLLING, *sg.WINDOWS).orderBy("code", "date").toPandas()
    got = ind.folded_panel(bars, ind.ROLLING, (), sg.windows_of()).select(rows.columns.tolist()).orderBy("code", "date").toPandas()
    pd.testing.assert_frame_equal(got, rows, check_exact=True)
    assert rows["mdd60"].notna().any()


def test_day_scores_equal_windows(spark):
    bars = bars_from_lineitem(spark, SMALL)
    names = ["pb_cs_rank", "ps_cs_rank", "value_score", "value_score_100", "candidate_score", "multifactor_score"]
    made = [sg.factor_panel(bars, read=(), days=days).select("code", "date", *names).orderBy("code", "date").toPandas() for days in (None, ())]
    pd.testing.assert_frame_equal(*made, check_exact=True)


@pytest.mark.parametrize(("alpha", "least"), [(2 / 21, 20), (1 / 3, 9), (2 / 201, 3)])
def test_exponential_mean_is_that_of_pandas(alpha, least):
    rng = np.random.default_rng(3)
    for k in range(30):
        x = np.round(np.cumsum(rng.normal(0, 1, rng.integers(1, 400))), 1)
        x[rng.random(len(x)) < 0.1 * (k % 3)] = np.nan
        assert np.array_equal(fd.ewm(x, alpha, least), pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean(), equal_nan=True)


def test_ranks_of_ties_and_nulls():
    x = np.array([3.0, 1.0, 1.0, 2.0, np.nan, 2.0, 2.0])
    assert np.array_equal(fd.rank_of_all(x), pd.Series(x).rank(pct=True), equal_nan=True) and np.isnan(fd.rank_of_all(x[4:5])).all()
