"""Queries of trade simulations, portfolios, regimes, patterns and similar windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane import config as cf
from ticklane.functions import indicators as ind
from ticklane.operators import backtest as bt
from ticklane.operators import metrics, patterns, similarity
from ticklane.operators import portfolio as pf
from ticklane.operators import signals as sg
from ticklane.plans import oracle as o
from ticklane.plans import signal_queries as sq
from ticklane.plans.indicator_queries import bars, rounded
from ticklane.sources.scratch import scratch_path, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE[name] = sql


def kept(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df written to the scratch folder and read again, where several steps read it."""
    return written(df, label)


# ---- ledger and virtual trades ---------------------------------------------------------------------------------------

_sim = sq.sql_scored().add(
    n="count(*) OVER (PARTITION BY code)", no=o.lead("open"), nd=o.lead("date"), lc="last_value(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    ld="max(date) OVER (PARTITION BY code)", e1=f"coalesce(close < ema50, false) OR coalesce(macd_dif < macd_dea AND {o.lag('macd_dif')} >= {o.lag('macd_dea')}, false)", e2="coalesce(close < boll_mid, false)",
    e3="coalesce(close >= boll_mid, false)", gate="coalesce(market_state_index IN ('trend_ok', 'neutral'), false) OR coalesce(market_state_stock = 'range', false)",
    h1="s1_entry = 1 AND coalesce(market_state_stock = 'trend', false)", h2="s2_entry = 1", h3="s3_long_entry = 1 AND coalesce(market_state_stock = 'range', false)")
_sim = _sim.table("SELECT * FROM {t}", "x").table(
    """SELECT code, 0::BIGINT AS rn, NULL::VARCHAR AS held, 0::BIGINT AS ei, NULL::DOUBLE AS first, NULL::DOUBLE AS stop, NULL::VARCHAR AS reason, NULL::VARCHAR AS was, 0::BIGINT AS wi, NULL::DOUBLE AS wfirst, NULL::DOUBLE AS wstop FROM (SELECT DISTINCT code FROM x)
    UNION ALL
    SELECT code, rn, held2, ei2, first2, CASE WHEN held2 IN ('S1', 'S2') AND s4_pyramid = 1 THEN greatest(stop2, psar, ema20) ELSE stop2 END, why, held, ei, first, stop
    FROM (SELECT *, coalesce(held1, entry) AS held2, CASE WHEN entry IS NOT NULL THEN rn ELSE ei END AS ei2,
                 CASE WHEN entry IS NOT NULL THEN CASE entry WHEN 'S2' THEN s2_stop WHEN 'S1' THEN s1_stop ELSE s3_stop END ELSE first END AS first2,
                 CASE WHEN entry IS NOT NULL THEN CASE entry WHEN 'S2' THEN s2_stop WHEN 'S1' THEN s1_stop ELSE s3_stop END ELSE stop END AS stop2
          FROM (SELECT *, CASE WHEN held1 IS NULL AND gate THEN CASE WHEN h2 THEN 'S2' WHEN h1 THEN 'S1' WHEN h3 THEN 'S3' END END AS entry
                FROM (SELECT *, CASE WHEN why IS NULL THEN held END AS held1
                      FROM (SELECT x.code, x.rn, x.gate, x.h1, x.h2, x.h3, x.s1_stop, x.s2_stop, x.s3_stop, x.s4_pyramid, x.psar, x.ema20, l.held, l.ei, l.first, l.stop,
                                   CASE WHEN l.held IS NULL THEN NULL WHEN x.close < l.stop THEN 'hit_stop' WHEN l.held = 'S1' AND x.e1 THEN 'ema50_break or macd_dead' WHEN l.held = 'S2' AND x.e2 THEN 'midband_fail' WHEN l.held = 'S3' AND x.e3 THEN 'mean_revert_tp' END AS why
                            FROM l JOIN x ON x.code = l.code AND x.rn = l.rn + 1 AND x.rn < x.n))))""", "l")  # fmt: skip
_sim = _sim.table("""SELECT code, was AS strategy, wi, rn AS wj, reason, wfirst AS first, wstop AS stop FROM l WHERE reason IS NOT NULL
    UNION ALL SELECT l.code, held, ei, l.rn, 'eod_close', first, stop FROM l JOIN (SELECT DISTINCT code, n FROM x) m ON m.code = l.code AND l.rn = m.n - 1 WHERE held IS NOT NULL""", "closed")
_sim = _sim.table("""SELECT c.code, c.strategy, e.date AS signal_date, e.date AS entry_date, e.no AS entry_price, CASE WHEN reason = 'eod_close' THEN e.ld ELSE q.nd END AS exit_date,
    CASE WHEN reason = 'eod_close' THEN e.lc ELSE q.no END AS exit_price, reason AS exit_reason, first AS initial_stop, c.stop AS stop_on_exit, CAST(floor(e.technical_score) AS INT) AS confidence,
    CASE c.strategy WHEN 'S2' THEN e.s2_pos WHEN 'S1' THEN e.s1_pos ELSE e.s3_pos END AS entry_pos, e.value_score, e.pb_cs_rank, e.ps_cs_rank
    FROM closed c JOIN x e ON e.code = c.code AND e.rn = c.wi JOIN x q ON q.code = c.code AND q.rn = c.wj""")
_sim = _sim.add(pnl_pct="(exit_price - entry_price) / entry_price - 0.0004")
TRADE = ["entry_price", "exit_price", "pnl_pct", "entry_pos", "initial_stop", "stop_on_exit", "value_score", "pb_cs_rank", "ps_cs_rank"]
KEYS = ("code", "strategy", "signal_date", "entry_date", "exit_date", "exit_reason", "confidence")


def clean(df: DataFrame) -> DataFrame:
    """NaN of a fold's pandas frame is null."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() == "double"})


def _entries(s: SparkSession, d: str) -> DataFrame:
    return sg.own_signals(bars(s, d), cf.DEFAULT, (*sg.RECURSIVE, "psar"), ("open", "high", "low"))


def ledger(s: SparkSession, d: str) -> DataFrame:
    """Trades without their valuation columns, which the default settings do not read."""
    return clean(bt.backtest_ledger(_entries(s, d)))


def virtual(s: SparkSession, d: str) -> DataFrame:
    return clean(bt.virtual_trades(_entries(s, d)))


def _valued(trades: DataFrame, s: SparkSession, d: str) -> DataFrame:
    return bt.with_values(trades, sg.add_valuation_ranks(bars(s, d)))


register("backtest_ledger", lambda s, d: rounded(_valued(ledger(s, d), s, d), TRADE, KEYS), _sim.show(TRADE, plain=KEYS))
_summary = "SELECT strategy, count(*) AS trades, round(avg((pnl_pct > 0)::INT), 6) AS win_rate, round(coalesce(avg(pnl_pct) FILTER (WHERE pnl_pct > 0), 0), 6) AS avg_win, round(coalesce(avg(pnl_pct) FILTER (WHERE pnl_pct <= 0), 0), 6) AS avg_loss, round(avg(pnl_pct), 6) AS expectancy FROM {t} GROUP BY strategy"
register("strategy_summary", lambda s, d: rounded(bt.strategy_summary(ledger(s, d)), ["win_rate", "avg_win", "avg_loss", "expectancy"], ("strategy", "trades")), _sim.end(_summary))
_tm = "SELECT {by}count(*) AS trade_count, round(avg((pnl_pct > 0)::INT), 6) AS hit_rate, round(avg(pnl_pct), 6) AS expectancy, round(avg(date_diff('day', entry_date, exit_date)), 6) AS avg_hold_days FROM {{t}}{group}"
_tmc = ["hit_rate", "expectancy", "avg_hold_days"]
register("trade_metrics", lambda s, d: rounded(metrics.trade_metrics(ledger(s, d), []), _tmc, ("trade_count",)), _sim.end(_tm.format(by="", group="")))
register("year_breakdown", lambda s, d: rounded(metrics.trade_metrics(ledger(s, d).withColumn("year", F.year("entry_date")), ["strategy", "year"]), _tmc, ("strategy", "year", "trade_count")),
         _sim.end(_tm.format(by="strategy, CAST(year(entry_date) AS INT) AS year, ", group=" GROUP BY 1, 2")))
register("selection_score", lambda s, d: rounded(pf.selection_score(ledger(s, d).withColumn("variant", F.col("strategy"))), ["selection_score"], ("variant",)),
         _sim.end("SELECT strategy AS variant, round(avg((pnl_pct > 0)::INT) * 100 + avg(pnl_pct) * 1000 + least(count(*), 300) * 0.01, 6) AS selection_score FROM {t} GROUP BY 1"))
_eq = "OVER (PARTITION BY code ORDER BY exit_date, entry_date ROWS UNBOUNDED PRECEDING)"
register("equity_curve", lambda s, d: rounded(metrics.equity_curve(ledger(s, d), ["code"], ["exit_date", "entry_date"]), ["equity", "drawdown", "max_drawdown"], ("code", "entry_date", "exit_date")),
         _sim.add(equity=f"product(1 + pnl_pct) {_eq}").add(_peak=f"greatest(max(equity) {_eq}, 1.0)").add(drawdown="equity / _peak - 1").add(max_drawdown=f"least(min(drawdown) {_eq}, 0.0)").show(["equity", "drawdown", "max_drawdown"], plain=("code", "entry_date", "exit_date")))
_virt = o.Chain(_sim.parts[: [p.startswith("l AS") for p in _sim.parts].index(True)], "x").table(
    "SELECT code, rn AS ei, s AS strategy, CASE s WHEN 'S2' THEN s2_stop WHEN 'S1' THEN s1_stop ELSE s3_stop END AS first FROM (SELECT *, unnest([CASE WHEN h2 THEN 'S2' END, CASE WHEN h1 THEN 'S1' END, CASE WHEN h3 THEN 'S3' END]) AS s FROM x WHERE gate AND rn < n) WHERE s IS NOT NULL", "ent").table(
    """SELECT code, ei, strategy, first, ei AS rn, first AS stop, first AS was, NULL::VARCHAR AS reason FROM ent WHERE false
    UNION ALL SELECT * FROM (
      SELECT k.code, k.ei, k.strategy, k.first, x.rn, CASE WHEN k.strategy <> 'S3' AND x.s4_pyramid = 1 THEN greatest(k.stop, x.psar, x.ema20) ELSE k.stop END AS stop, k.stop AS was,
             CASE WHEN x.close < k.stop THEN 'hit_stop' WHEN k.strategy = 'S1' AND x.e1 THEN 'ema50_break or macd_dead' WHEN k.strategy = 'S2' AND x.e2 THEN 'midband_fail' WHEN k.strategy = 'S3' AND x.e3 THEN 'mean_revert_tp' END AS reason
      FROM v k JOIN x ON x.code = k.code AND x.rn = k.rn + 1 AND x.rn < x.n WHERE k.reason IS NULL)""".replace("WHERE false", "").replace("ei AS rn, first AS stop", "ei - 1 AS rn, first AS stop"), "v").table(
    "SELECT code, ei, strategy, arg_max(first, rn) AS first, arg_max(stop, rn) AS stop, arg_max(was, rn) AS was, arg_max(coalesce(reason, ''), rn) AS reason, max(rn) AS wj FROM v GROUP BY 1, 2, 3", "vend").table(
    """SELECT c.code, c.strategy, e.date AS signal_date, e.nd AS entry_date, e.no AS entry_price, CASE WHEN reason = '' THEN e.ld ELSE q.nd END AS exit_date, CASE WHEN reason = '' THEN e.lc ELSE q.no END AS exit_price,
    CASE WHEN reason = '' THEN 'eod_close' ELSE reason END AS exit_reason, c.first AS initial_stop, CASE WHEN reason = '' THEN c.stop WHEN reason = 'hit_stop' THEN c.was END AS stop_on_exit, CAST(floor(e.technical_score) AS INT) AS confidence,
    CASE c.strategy WHEN 'S2' THEN e.s2_pos WHEN 'S1' THEN e.s1_pos ELSE e.s3_pos END AS entry_pos, e.value_score, e.pb_cs_rank, e.ps_cs_rank FROM vend c JOIN x e ON e.code = c.code AND e.rn = c.ei JOIN x q ON q.code = c.code AND q.rn = c.wj""").add(
    pnl_pct="(exit_price - entry_price) / entry_price - 0.0004")
register("virtual_trades", lambda s, d: rounded(_valued(virtual(s, d), s, d), TRADE, KEYS), _virt.show(TRADE, plain=KEYS))


def _predictions(df: DataFrame, key: str = "code") -> DataFrame:
    """A stand-in for a model's output: a fixed function of the key and the day."""
    return df.withColumn("pred", (F.pmod(F.col(key) * 7919 + F.datediff("date", F.lit("1990-01-01").cast("date")) * 104729, F.lit(1000)) / 1000.0 - 0.45) / 10)


SQL_PRED = "(((code * 7919 + date_diff('day', DATE '1990-01-01', date) * 104729) % 1000) / 1000.0 - 0.45) / 10"


def join_predictions(s: SparkSession, d: str) -> DataFrame:
    """Ledger with predictions by (code, signal day); the predictions are one row a key."""
    preds = _predictions(bars(s, d).select("code", "date")).dropDuplicates(["code", "date"])
    trades = ledger(s, d)
    return rounded(trades.join(preds.withColumnRenamed("date", "signal_date"), ["code", "signal_date"], "left"), ["pnl_pct", "pred"], ("code", "signal_date", "strategy"))


register("join_predictions", join_predictions, _sim.end(f"SELECT t.code, signal_date, strategy, round(pnl_pct, 6) AS pnl_pct, round(pred, 6) AS pred FROM {{t}} t LEFT JOIN (SELECT code, date, {SQL_PRED} AS pred FROM bars) p ON p.code = t.code AND p.date = t.signal_date"))


def training_frame(s: SparkSession, d: str) -> DataFrame:
    """Trades with the features of their entry day."""
    feats = ind.add_atr(ind.add_rsi(bars(s, d))).select("code", F.col("date").alias("signal_date"), "rsi14", "atr14", "turnover")
    return rounded(ledger(s, d).join(feats, ["code", "signal_date"]), ["pnl_pct", "rsi14", "atr14", "turnover"], ("code", "signal_date", "strategy"))


register("training_frame", training_frame, _sim.end("SELECT t.code, t.signal_date, t.strategy, round(pnl_pct, 6) AS pnl_pct, round(rsi14, 6) AS rsi14, round(atr14, 6) AS atr14, round(turnover, 6) AS turnover FROM {t} t JOIN x ON x.code = t.code AND x.date = t.signal_date"))
register("join_features", lambda s, d: rounded(sg.today_candidates(sq.signals(s, d)).select("code", "date", "strategy").join(ind.add_rsi(bars(s, d)).select("code", "date", "rsi14", "close"), ["code", "date"], "left"), ["rsi14", "close"], ("code", "date", "strategy")),
         sq.sql_signals().add(strategy=sq.STRATEGY).show(["rsi14", "close"], "strategy <> 'MF' AND date = (SELECT max(date) FROM bars)", ("code", "date", "strategy")))

# ---- risk budget -----------------------------------------------------------------------------------------------------


def risk_preds(s: SparkSession, d: str) -> DataFrame:
    df = _predictions(bars(s, d).select("code", "date", "open"))
    mae = -(F.pmod(F.col("code") * 31 + F.datediff("date", F.lit("1990-01-01").cast("date")) * 17, F.lit(100)) / 1000.0) - 0.005
    return df.select("code", "date", "open", F.col("pred").alias("pred_ret"), mae.alias("pred_mae"), F.lit("base").alias("variant"))


_risk = o.Chain().add(pred_ret=SQL_PRED, pred_mae="-(((code * 31 + date_diff('day', DATE '1990-01-01', date) * 17) % 100) / 1000.0) - 0.005").add(risk="abs(pred_mae)").add(score="pred_ret / (risk + 1e-6)")
_pool = _risk.table("SELECT * FROM {t} WHERE pred_mae >= -0.08 AND pred_ret > 0")
_prefix = _pool.table("SELECT *, sum(risk) OVER (PARTITION BY date ORDER BY score DESC, code ROWS UNBOUNDED PRECEDING) AS _s FROM {t} WHERE risk > 0").table(
    "SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS place FROM {t} WHERE _s <= 0.12 + 1e-15")
register("risk_candidates", lambda s, d: rounded(bt.candidate_pool(bt.add_risk(risk_preds(s, d))), ["risk", "score"]), _pool.show(["risk", "score"]))
register("topcap_prefix", lambda s, d: rounded(bt.top_prefix(bt.candidate_pool(bt.add_risk(risk_preds(s, d)))), ["risk"], ("code", "date", "place")), _prefix.show(["risk"], plain=("code", "date", "place")))
register("risk_parity", lambda s, d: rounded(bt.risk_parity(bt.top_prefix(bt.candidate_pool(bt.add_risk(risk_preds(s, d))))), ["weight"]),
         _prefix.add(_i="1.0 / greatest(risk, 1e-6)").add(weight="_i / (sum(_i) OVER (PARTITION BY date) + 1e-12)").show(["weight"]))
_held = "CAST([] AS STRUCT(code BIGINT, out_ BIGINT, w DOUBLE)[])"
# A day's map holds the codes that can be held then.  Of the days after a code was on top last, one at least of every two counts as out (a
# day on its stop without a bar after it is followed by one), and two send it off: five days, and the first bar after them if there was none.
_budget = o.Chain(_prefix.parts, _risk.at).table("SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM {t})", "dk", True).table(
    f"SELECT x.code, x.open, x.pred_mae, x.risk, k, CASE WHEN p.code IS NOT NULL THEN k END AS was FROM {{t}} x JOIN dk USING (date) LEFT JOIN {_prefix.at} p ON p.code = x.code AND p.date = x.date", "dr").table(
    "SELECT * FROM (SELECT *, last_value(was IGNORE NULLS) OVER (PARTITION BY code ORDER BY k ROWS UNBOUNDED PRECEDING) AS top_at, lag(k) OVER (PARTITION BY code ORDER BY k) AS bar_at FROM dr) WHERE k <= top_at + 5 OR bar_at < top_at + 5", "dn").table(
    "SELECT dk.date, dk.k, map_from_entries(coalesce(list((code, {{'o': open, 's': pred_mae < -0.08, 'r': risk}})) FILTER (WHERE code IS NOT NULL), [])) AS m FROM dk LEFT JOIN dn USING (k) GROUP BY 1, 2", "dd", True).table(
    f"SELECT a.k, a.m, coalesce((SELECT list(p.code ORDER BY place) FROM {_prefix.at} p WHERE p.date = a.date), []) AS top, b.date AS d1, b.m AS m1, c.date AS d2, c.m AS m2 FROM dd a JOIN dd b ON b.k = a.k + 1 JOIN dd c ON c.k = a.k + 2", "ds", True).table(
    f"""SELECT 0::BIGINT AS k, {_held} AS held, 1.0::DOUBLE AS equity, 1.0::DOUBLE AS peak, 0.0::DOUBLE AS worst, 0.0::DOUBLE AS ret, 0::BIGINT AS buys, 0::BIGINT AS sells, NULL::DATE AS d1, NULL::DATE AS d2
    UNION ALL
    SELECT k, h3, e, greatest(peak, e), least(worst, e / (greatest(peak, e) + 1e-12) - 1), ret2, len(bought), len(gone), d1, d2
    FROM (SELECT *, equity * (1 + ret2) AS e
          FROM (SELECT *, CASE WHEN coalesce(list_sum(list_transform(two, lambda x: x.w)), 0) > 1e-12 THEN list_sum(list_transform(two, lambda x: x.w * (x.b / (x.a + 1e-12) - 1))) / list_sum(list_transform(two, lambda x: x.w)) ELSE 0 END AS ret2
                FROM (SELECT *, list_filter(list_transform(h3, lambda h: {{{{'w': h.w, 'a': m1[h.code].o, 'b': m2[h.code].o}}}}), lambda x: x.w > 0 AND x.a IS NOT NULL AND x.b IS NOT NULL) AS two
                      FROM (SELECT *, list_filter(h1, lambda h: NOT h.go OR m1[h.code] IS NULL).list_transform(lambda h: {{{{'code': h.code, 'out_': h.out_, 'w': h.w}}}})
                                   || list_filter(bought, lambda c: m1[c] IS NOT NULL).list_transform(lambda c: {{{{'code': c, 'out_': 0::BIGINT, 'w': (1 / greatest(m[c].r, 1e-6)) / (list_sum(list_transform(bought, lambda z: 1 / greatest(m[z].r, 1e-6))) + 1e-12)}}}}) AS h3
                            FROM (SELECT *, list_filter(top, lambda c: NOT list_contains(list_transform(held, lambda h: h.code), c))[1:greatest(0, len(top) - (len(h1) - len(gone)))] AS bought
                                  FROM (SELECT *, list_filter(h1, lambda h: h.go) AS gone
                                        FROM (SELECT *, list_transform(h0, lambda h: {{{{'code': h.code, 'out_': h.out_, 'w': h.w, 'go': h.st OR h.out_ >= 2}}}}) AS h1
                                              FROM (SELECT ds.*, sim.held, sim.equity, sim.peak, sim.worst, list_transform(sim.held, lambda h: {{{{'code': h.code, 'w': h.w, 'st': coalesce(ds.m[h.code].s, false),
                                                           'out_': CASE WHEN coalesce(ds.m[h.code].s, false) THEN h.out_ WHEN list_contains(ds.top, h.code) THEN 0 ELSE h.out_ + 1 END}}}}) AS h0
                                                    FROM sim JOIN ds ON ds.k = sim.k + 1))))))))""", "sim")  # fmt: skip
register("risk_budget_sim", lambda s, d: rounded(bt.risk_budget_sim(risk_preds(s, d)), ["ret", "equity", "drawdown", "max_drawdown"], ("date_open", "next_date_open", "n_positions", "buys", "sells")),
         _budget.end("SELECT d1 AS date_open, d2 AS next_date_open, CAST(len(held) AS INT) AS n_positions, CAST(buys AS INT) AS buys, CAST(sells AS INT) AS sells, round(ret, 6) AS ret, round(equity, 6) AS equity, round(equity / (peak + 1e-12) - 1, 6) AS drawdown, round(worst, 6) AS max_drawdown FROM sim WHERE k > 0"))


def positions_state(s: SparkSession, d: str) -> DataFrame:
    """A positions table written and read again with its types; an unknown status counts as OPEN."""
    held = bars(s, d).groupBy("code").agg(F.max("date").alias("entry_date"), F.max_by("close", "date").alias("entry_price")).where(F.col("code") % 3 == 0)
    held = held.select(F.col("code").cast("string").alias("code"), F.when(F.col("code") % 2 == 0, "PENDING_ENTRY").alias("status"), "entry_date", "entry_price", (F.col("code") % 2).cast("int").alias("out_counter"))
    return kept(s, held, "positions").fillna({"status": "OPEN"})


register("positions_state", positions_state, o.Chain().end("SELECT CAST(code AS VARCHAR) AS code, CASE WHEN code % 2 = 0 THEN 'PENDING_ENTRY' ELSE 'OPEN' END AS status, max(date) AS entry_date, max_by(close, date) AS entry_price, CAST(code % 2 AS INT) AS out_counter FROM {t} WHERE code % 3 = 0 GROUP BY code"))


def live_orders(s: SparkSession, d: str) -> DataFrame:
    preds = risk_preds(s, d)
    last = preds.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").agg(F.max("date").alias("date"))
    held = bars(s, d).select("code").distinct().where(F.col("code") % 3 == 0).select("code", (F.col("code") % 2).cast("int").alias("out_counter"))
    return rounded(bt.live_orders(held, preds.join(F.broadcast(last), "date"))[0], ["pred_ret", "pred_mae", "score"], ("code", "side", "reason"))


_live = _risk.table("SELECT * FROM {t} WHERE date = (SELECT max(date) FROM (SELECT date FROM bars GROUP BY date HAVING count(*) >= 5))", "day").table(
    "SELECT *, row_number() OVER (ORDER BY score DESC, code) AS place FROM (SELECT *, sum(risk) OVER (ORDER BY score DESC, code ROWS UNBOUNDED PRECEDING) AS _s FROM day WHERE pred_mae >= -0.08 AND pred_ret > 0 AND risk > 0) WHERE _s <= 0.12 + 1e-15", "top").table(
    "SELECT h.code, d.pred_ret, d.pred_mae, d.score, CASE WHEN d.pred_mae < -0.08 THEN 'risk_hard_stop' WHEN t.place IS NULL AND h.code % 2 + 1 >= 2 THEN 'out_of_topcap' END AS reason FROM (SELECT DISTINCT code FROM bars WHERE code % 3 = 0) h LEFT JOIN day d USING (code) LEFT JOIN top t USING (code)", "held")
register("live_orders", live_orders, _live.end("""SELECT code, 'SELL' AS side, reason, round(pred_ret, 6) AS pred_ret, round(pred_mae, 6) AS pred_mae, round(score, 6) AS score FROM held WHERE reason IS NOT NULL
    UNION ALL SELECT code, 'BUY', 'enter_topcap', round(pred_ret, 6), round(pred_mae, 6), round(score, 6) FROM (SELECT *, row_number() OVER (ORDER BY place) AS k FROM top WHERE code NOT IN (SELECT code FROM held))
    WHERE k <= (SELECT count(*) FROM top) - (SELECT count(*) FROM held WHERE reason IS NULL)"""))
register("bandit", lambda s, d: bt.bandit_weights(bars(s, d).select(F.col("code").alias("key"), F.col("date").alias("step"), (F.dayofmonth("date") % 3).cast("int").alias("arm"), (F.col("pct_chg") / 100).alias("reward"))).select(F.col("key").alias("code"), *[F.round(F.col("weights")[i], 6).alias(f"w{i}") for i in range(3)]),
         o.Chain().add(arm="day(date) % 3", r="pct_chg / 100").table("SELECT * FROM {t}", "x").table("""SELECT code, 0::BIGINT AS rn, 1.0 / 3 AS w0, 1.0 / 3 AS w1, 1.0 / 3 AS w2 FROM (SELECT DISTINCT code FROM x) UNION ALL
         SELECT code, rn, a / (a + b + c), b / (a + b + c), c / (a + b + c) FROM (SELECT x.code, x.rn, CASE WHEN arm = 0 THEN greatest(0.1, w0 + r) ELSE w0 END AS a, CASE WHEN arm = 1 THEN greatest(0.1, w1 + r) ELSE w1 END AS b,
         CASE WHEN arm = 2 THEN greatest(0.1, w2 + r) ELSE w2 END AS c FROM l JOIN x ON x.code = l.code AND x.rn = l.rn + 1)""", "l").end("SELECT code, round(arg_max(w0, rn), 6) AS w0, round(arg_max(w1, rn), 6) AS w1, round(arg_max(w2, rn), 6) AS w2 FROM l GROUP BY code"))  # fmt: skip

# ---- patterns --------------------------------------------------------------------------------------------------------

_basic = o.add_atr(o.Chain()).add(ret1=o.roc("close", 1), v5=o.sma("volume", 5), v20=o.sma("volume", 20), ma30=o.sma("close", 30), n="count(*) OVER (PARTITION BY code)", i="CAST(rn - 1 AS INT)", nd=o.lead("date"))
_floor = "CASE WHEN count(low) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN min(low) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END"
_basic = _basic.add(nc=o.lead("close"), floor=_floor, small="CASE WHEN ret1 > 0 AND ret1 < 0.012 THEN 1 ELSE 0 END", v50=o.lag("v5", 3)).add(cnt=o.total("small", 4), k=f"CASE WHEN {o.lead('close', 1)} > floor THEN 1 WHEN {o.lead('close', 2)} > floor THEN 2 WHEN {o.lead('close', 3)} > floor THEN 3 END")
_pull = "SELECT code, date, nd AS entry_date, 'PULLBACK_TO_MA30' AS pattern, i AS bar_index, CAST(i + 1 AS INT) AS entry_index, CAST(NULL AS INT) AS flag_n FROM {t} WHERE n >= 35 AND close > ma30 AND low <= ma30 * 1.005 AND volume <= v20 * 0.8 AND nc >= ma30 * 0.997"
_false = "SELECT code, date, entry_date, 'FALSE_BREAKDOWN' AS pattern, i AS bar_index, CAST(i + k AS INT) AS entry_index, CAST(NULL AS INT) AS flag_n FROM (SELECT *, CASE k WHEN 1 THEN " + o.lead("date", 1) + " WHEN 2 THEN " + o.lead("date", 2) + " WHEN 3 THEN " + o.lead("date", 3) + " END AS entry_date FROM {t}) WHERE low < floor AND volume <= v20 * 0.8 AND k IS NOT NULL"
_smallup = "SELECT code, date, nd AS entry_date, 'SMALL_UP_DAYS_GENTLE_VOL' AS pattern, i AS bar_index, CAST(i + 1 AS INT) AS entry_index, CAST(NULL AS INT) AS flag_n FROM {t} WHERE cnt >= 3 AND v5 >= v50"
for _n, _f, _s in (("pat_pullback", patterns.pullback_to_mean, _pull), ("pat_false_breakdown", patterns.false_breakdown, _false), ("pat_small_up", patterns.small_up_days, _smallup)):
    register(_n, lambda s, d, f=_f: f(ind.add_pattern_basics(bars(s, d))), _basic.end(_s))
LOOSE = patterns.Flag(day0_ret=0.02, day0_volume=1.0, day1_range=0.2, day1_body=1.0, base_range=0.2, base_volume_cv=3.0, band=0.05, quiet=1.5, quiet_vs_day0=1.5, breakout=0.0, breakout_volume=0.5)
_mean20 = lambda x: f"CASE WHEN count({x}) {o.over(20)} = 20 THEN avg({x}) {o.over(20)} END"
_share = "nullif(high - low, 0) / close"
_flags = o.Chain(_basic.parts, _basic.at).add(rng=_share, body_=f"{o.clip('abs(close - open) / (nullif(high - low, 0) + 1e-12)', 0.0, 10.0)}").add(
    go=f"""i > 0 AND ret1 >= {LOOSE.day0_ret} AND volume >= v20 * {LOOSE.day0_volume} AND {_mean20('rng')} <= {LOOSE.base_range}
    AND CASE WHEN count(volume) {o.over(20)} = 20 THEN stddev_pop(volume) {o.over(20)} / (avg(volume) {o.over(20)} + 1e-12) END <= {LOOSE.base_volume_cv}
    AND {o.lead('rng')} <= {LOOSE.day1_range} AND {o.lead('body_')} <= {LOOSE.day1_body}""").table("SELECT * FROM {t}", "fx", True).table(
    "SELECT a.code, a.date, a.i, a.n, a.volume, greatest(a.high, b.high) AS top, least(a.low, b.low) AS bottom FROM fx a JOIN fx b ON b.code = a.code AND b.i = a.i + 1 WHERE a.go AND greatest(a.high, b.high) > least(a.low, b.low)", "st", True).table(
    f"""SELECT s.code, s.date, s.i, s.n, s.top, s.bottom, s.volume, k.k AS len FROM st s JOIN (SELECT unnest(range({LOOSE.shortest}, {LOOSE.longest + 1})) AS k) k ON s.i + 1 + k.k < s.n""", "le", True).table(
    f"""SELECT l.code, l.date, l.i, l.n, l.top, l.len FROM (SELECT *, i + 1 + unnest(range(1, len + 1)) AS at FROM le) l JOIN fx r ON r.code = l.code AND r.i = l.at GROUP BY l.code, l.date, l.i, l.n, l.top, l.len, l.bottom, l.volume
    HAVING max(r.high) <= l.top * (1 + {LOOSE.band}) AND min(r.low) >= l.bottom * (1 - {LOOSE.band}) AND avg(r.volume) <= avg(r.v20) * {LOOSE.quiet} AND avg(r.volume) <= l.volume * {LOOSE.quiet_vs_day0}""", "fl", True).table(
    f"""SELECT f.code, f.date, f.i, f.len, min(r.i) AS j FROM (SELECT *, i + 1 + len + unnest(range(1, {LOOSE.confirm_days + 1})) AS at FROM fl) f JOIN fx r ON r.code = f.code AND r.i = f.at
    WHERE r.i <= f.n - 2 AND r.close >= f.top * (1 + {LOOSE.breakout}) AND r.volume >= r.v20 * {LOOSE.breakout_volume} AND r.nc >= f.top * (1 - {LOOSE.hold}) GROUP BY ALL""", "br").table(
    """SELECT h.code, h.date, e.date AS entry_date, 'HIGH_TIGHT_FLAG' AS pattern, h.i AS bar_index, CAST(h.j + 1 AS INT) AS entry_index, CAST(h.len AS INT) AS flag_n
    FROM (SELECT code, date, i, min(len) AS len, arg_min(j, len) AS j FROM br GROUP BY 1, 2, 3) h JOIN fx e ON e.code = h.code AND e.i = h.j + 1""", "htf")  # fmt: skip
register("pat_htf", lambda s, d: patterns.high_tight_flag(ind.add_pattern_basics(bars(s, d)), LOOSE), _flags.end("SELECT * FROM htf"))
_events = o.Chain(_flags.parts, _basic.at).table(f"SELECT * FROM ({_pull} UNION ALL {_false} UNION ALL {_smallup} UNION ALL SELECT * FROM htf) WHERE entry_date IS NOT NULL".replace("{t}", _basic.at), "ev").table(
    f"SELECT code, date AS entry_date, close AS entry_close, max(close) {o.ahead(30)} AS fut_max_close, min(close) {o.ahead(30)} AS fut_min_close FROM bars", "fw").table(
    "SELECT e.*, entry_close, fut_max_close, fut_min_close, fut_max_close / entry_close - 1 AS up, fut_min_close / entry_close - 1 AS dn FROM ev e LEFT JOIN fw USING (code, entry_date)")


def pattern_events(s: SparkSession, d: str) -> DataFrame:
    """Events of all four patterns, the flag loosened so that the test bars have some."""
    return patterns.with_forward(patterns.scan(bars(s, d), LOOSE), bars(s, d))


_fwd = ["entry_close", "fut_max_close", "fut_min_close", "fwd_max_ret", "fwd_min_ret"]
register("pattern_events", lambda s, d: rounded(pattern_events(s, d), _fwd, ("code", "date", "entry_date", "pattern", "bar_index", "entry_index")), _events.add(fwd_max_ret="up", fwd_min_ret="dn").show(_fwd, plain=("code", "date", "entry_date", "pattern", "bar_index", "entry_index")))
register("event_forward", lambda s, d: rounded(patterns.with_forward(patterns.pullback_to_mean(ind.add_pattern_basics(bars(s, d))), bars(s, d)), _fwd, ("code", "date", "entry_date")), _events.add(fwd_max_ret="up", fwd_min_ret="dn").show(_fwd, "pattern = 'PULLBACK_TO_MA30'", ("code", "date", "entry_date")))
_ps = {"mean_up": "avg(up)", "median_up": "median(up)", "p75_up": "quantile_cont(up, 0.75)", "p90_up": "quantile_cont(up, 0.9)", "min_up": "min(up)", "max_up": "max(up)", "mean_dn": "avg(dn)", "median_dn": "median(dn)", "p25_dn": "quantile_cont(dn, 0.25)", "p10_dn": "quantile_cont(dn, 0.1)", "min_dn": "min(dn)", "max_dn": "max(dn)", "hit_up_5": "avg((up >= 0.05)::INT)", "hit_up_10": "avg((up >= 0.10)::INT)", "hit_up_20": "avg((up >= 0.20)::INT)"}
register("pattern_summary", lambda s, d: rounded(patterns.summary(pattern_events(s, d)), list(_ps), ("pattern", "count")), _events.end("SELECT pattern, count(*) AS count, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _ps.items()) + " FROM {t} WHERE up IS NOT NULL AND dn IS NOT NULL GROUP BY 1"))

# ---- similar windows and as-of -----------------------------------------------------------------------------------------


def targets(s: SparkSession, d: str) -> DataFrame:
    """Every code as of one day."""
    return bars(s, d).select("code").distinct().withColumn("target_date", F.lit("1996-12-31").cast("date"))


def asked(codes: DataFrame) -> DataFrame:
    """The last windows before a day, of every code whose number is divisible by 50 (and of code 1). codes: similarity.pack_bars, stored."""
    some = codes.where("code % 50 = 0 OR code = 1")
    at = similarity.asof(similarity.packed_vectors(some).withColumnRenamed("end_date", "date"), some.select("code", F.lit("1996-12-31").cast("date").alias("target_date")))
    return at.select(F.col("code").alias("target_code"), F.col("date").alias("target_end"), F.col("vec").alias("target_vec"))


def packed(s: SparkSession, d: str) -> DataFrame:
    return written(similarity.pack_bars(bars(s, d)), "codes", similarity.CODES)


def similar(s: SparkSession, d: str, codes: DataFrame | None = None) -> DataFrame:
    """The windows most like the asked ones, among all windows. codes: packed(), if it is there already."""
    codes = codes if codes is not None else packed(s, d)
    return similarity.search_packed(codes, asked(codes)).withColumn("similarity", F.round("similarity", 6))


def similar_rows(s: SparkSession, d: str) -> DataFrame:
    """What a chart of the similar windows shows; bars are read from where the search found them."""
    codes = packed(s, d)
    return similarity.packed_rows(codes, similar(s, d, codes))


_vec = o.Chain().add(win=f"list({{{{'o': open, 'h': high, 'l': low, 'c': close, 'p': preclose, 't': turnover, 'g': pct_chg, 'd': date}}}}) {o.over(7)}".replace("{{", "{").replace("}}", "}"), left_=f"count(*) {o.ahead(5)}", unit_t="CASE WHEN max(abs(turnover)) OVER () > 1.5 THEN 100 ELSE 1 END", unit_g="CASE WHEN max(abs(pct_chg)) OVER () > 1.5 THEN 100 ELSE 1 END")
_vecs = "SELECT code, win[1].d AS start_date, date AS end_date, " + " || ".join(f"list_transform(win, lambda x: x.{k} / win[1].c)" for k in "ohlcp") + " || list_transform(win, lambda x: x.t / unit_t) || list_transform(win, lambda x: x.g / unit_g) AS vec, left_ AS future_days FROM {t} WHERE len(win) = 7"
_vec = o.Chain([*_vec.parts, f"vecs AS ({_vecs.replace('{t}', _vec.at)})"], "vecs").table("SELECT code AS target_code, max(end_date) AS target_end, max_by(vec, end_date) AS target_vec FROM vecs WHERE (code % 50 = 0 OR code = 1) AND end_date <= DATE '1996-12-31' GROUP BY 1", "tg").table(
    "SELECT target_code, target_end, code, start_date, end_date, round(1 / (1 + list_distance(vec, target_vec)), 9) AS sim, future_days FROM vecs, tg WHERE NOT (code = target_code AND end_date = target_end)")
register("similar_windows", similar, _vec.end("SELECT target_code, target_end, code, start_date, end_date, round(sim, 6) AS similarity, place, future_days FROM (SELECT *, row_number() OVER (PARTITION BY target_code, target_end ORDER BY sim DESC, code, start_date) AS place FROM {t}) WHERE place <= 10"))
_REL = [f"rel_{p}" for p in similarity.PRICES]
register("similar_rows", lambda s, d: rounded(similar_rows(s, d), _REL, ("code", "end_date", "offset", "date", "future_days")),
         _vec.table("SELECT DISTINCT code, end_date FROM (SELECT *, row_number() OVER (PARTITION BY target_code, target_end ORDER BY sim DESC, code, start_date) AS place FROM {t}) WHERE place <= 10", "top").table(
             "SELECT t.code, t.end_date, e.rn AS er, nullif(f.close, 0) AS base FROM top t JOIN bars e ON e.code = t.code AND e.date = t.end_date JOIN bars f ON f.code = t.code AND f.rn = e.rn - 6", "tw", True).end(
             "SELECT w.code, w.end_date, CAST(b.rn - er AS INT) AS \"offset\", b.date, sum((b.rn > er)::INT) OVER (PARTITION BY w.code, w.end_date) AS future_days, " + ", ".join(f"round(b.{p} / coalesce(base, 1), 6) AS rel_{p}" for p in similarity.PRICES) + " FROM (SELECT *, er + unnest(range(-6, 6)) AS at FROM tw) w JOIN bars b ON b.code = w.code AND b.rn = w.at"))
register("asof_target", lambda s, d: similarity.asof(bars(s, d).select("code", "date", "close"), targets(s, d)), o.Chain().end("SELECT code, DATE '1996-12-31' AS target_date, max(date) AS date, max_by(close, date) AS close FROM {t} WHERE date <= DATE '1996-12-31' GROUP BY 1"))
