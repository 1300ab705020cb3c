"""Queries of models, tuning, walk-forward metrics, the remote source and stateful streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane import config as cf
from ticklane.functions import indicators as ind
from ticklane.operators import backtest as bt
from ticklane.operators import buckets
from ticklane.operators import labels as lb
from ticklane.operators import metrics as mt
from ticklane.operators import ml
from ticklane.operators import quantile_trees as qt
from ticklane.operators import sequence_model as sm
from ticklane.operators import signals as sg
from ticklane.operators import training as tr
from ticklane.plans import label_queries as lq
from ticklane.plans import oracle as o
from ticklane.plans import signal_queries as sq
from ticklane.plans import trade_queries as tq
from ticklane.plans.indicator_queries import PANEL, bars, rounded
from ticklane.sources import remote
from ticklane.sources.scratch import scratch_path, written
from ticklane.streaming import events as ev
from ticklane.streaming import positions as ps

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FEATURES = ["rsi14", "boll_bw", "roc10", "clv", "body_ratio", "rvol20", "turnover"]
#: All indicators of the panel, and turnover and change.
WIDE = [*PANEL, "turnover", "pct_chg"]
SPLIT = "1998-01-01"


def register(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE[name] = sql


def feature_rows(s: SparkSession, d: str) -> DataFrame:
    """Features without a fold."""
    df = ind.add_bollinger(ind.add_rsi(bars(s, d))).withColumns({"roc10": ind.roc("close", 10), "clv": ind.clv(), "rvol20": ind.rvol()} | ind.wick_ratios())
    return df.where("rsi14 IS NOT NULL AND boll_bw IS NOT NULL").select("code", "date", "close", *FEATURES)


def wide_rows(s: SparkSession, d: str) -> DataFrame:
    """The whole panel with the labels of the models."""
    df = ind.add_panel(lb.ret_mae(bars(s, d)))  # windows before the fold
    return tq.kept(s, df.withColumn("y", F.when(F.col("ret_20").isNotNull(), (F.col("ret_20") > 0.02).cast("int"))), "wide")


def regressor(s: SparkSession, d: str) -> DataFrame:
    df = wide_rows(s, d)
    model = ml.train_regressor(df.where(f"date < '{SPLIT}'"), WIDE, "ret_20")
    out = ml.predict(model, df.where(f"date >= '{SPLIT}' AND ret_20 IS NOT NULL"), WIDE, "pred").withColumn("y", F.col("ret_20"))
    return rounded(mt.regression_metrics(out), ["mae", "rmse", "r2", "pearson"], ())


def classifier(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        df = wide_rows(s, d)
        model = ml.train_classifier(df.where(f"date < '{SPLIT}'"), WIDE, "y", kind)
        out = ml.score(model, df.where(f"date >= '{SPLIT}' AND y IS NOT NULL"), WIDE, ["code", "date", "y"])
        return rounded(mt.eval_probs(tq.kept(s, out, "probs")), ["roc_auc", "average_precision", "precision", "recall", "f1"], ())

    return run


def sequence_classifier(s: SparkSession, d: str) -> DataFrame:
    """A perceptron over the last 21 rows' features, learnt before 1997 and stopped by 1997's top tenth, on what comes later."""
    df, more = lb.cs_quantile_label(feature_rows(s, d), 21, least=5), ["label", "fwd"]
    how = sm.Training(least=5)
    rows = lb.unpack_sequences(written(lb.pack_sequences(df, FEATURES, more), "codes", 64), len(FEATURES), more)
    fitted = sm.train_sequences(rows.where(f"date < '{SPLIT}'"), "seq", "label", "fwd", F.col("date") >= "1997-01-01", how)
    late = tq.kept(s, sm.upper(fitted.model, rows.where(f"date >= '{SPLIT}' AND label IS NOT NULL"), "seq").drop("seq"), "ranked")
    hit = mt.topfrac_hit(late, "prob", "fwd", how.fraction, how.threshold, how.least)
    sums = mt.class_metrics(late.select(F.col("label").alias("y"), F.col("_probs").alias("probs")))
    best = hit.join(F.broadcast(sums), F.lit(True), "inner").withColumns({"epochs": F.lit(len(fitted.hits)), "best_epoch": F.lit(fitted.best_epoch), "valid_hit": F.lit(max(fitted.hits))})  # one row each
    return rounded(best, ["topfrac_hit", "valid_hit", "accuracy", "balanced_accuracy", "f1_up", "confidence", "margin", "entropy"], ("days", "epochs", "best_epoch"), 4)


def quantiles(s: SparkSession, d: str) -> DataFrame:
    """Boosted 0.7-quantile of the return and 0.1-quantile of the drawdown: rounds chosen on the last 126 days before the split, judged after it."""
    df = wide_rows(s, d)
    train = lb.time_split(df.where(f"date < '{SPLIT}' AND ret_20 IS NOT NULL AND mae_20 IS NOT NULL"), 126)
    wanted = {"ret_20": 0.7, "mae_20": 0.1}
    forests = qt.fit(train, WIDE, wanted, F.col("is_valid"))
    out = df.where(f"date >= '{SPLIT}' AND ret_20 IS NOT NULL AND mae_20 IS NOT NULL")
    for y in wanted:
        out = qt.predict(forests[y], out, f"q_{y}")
    out = tq.kept(s, out.select(*wanted, *[f"q_{y}" for y in wanted]), "quantiles")
    one = lambda y, q: mt.quantile_metrics(out, q, y, f"q_{y}").withColumns({"target": F.lit(y), "rounds": F.lit(len(forests[y].trees))})
    return rounded(one("ret_20", 0.7).unionByName(one("mae_20", 0.1)), ["pinball", "coverage", "top_mean"], ("target", "rounds"))


def train_report(s: SparkSession, d: str) -> DataFrame:
    """The artefact of a return model: trained on the ledger's trades with the panel of their signal day, loaded and applied to all rows of the last year."""
    trades, daily = tq.kept(s, tq.ledger(s, d).select("code", "signal_date", "strategy", "pnl_pct"), "trades"), bars(s, d)
    since = F.add_months(F.lit(daily.agg(F.max("date")).first()[0]), -12)
    # only rows that are learnt from or scored are kept; they are told before the panel's columns are made
    days = trades.select("code", F.col("signal_date").alias("date")).distinct().withColumn("_learnt", F.lit(True))
    daily = daily.join(days, ["code", "date"], "left").withColumn("_used", F.coalesce("_learnt", F.lit(False)) | (F.col("date") >= since)).drop("_learnt")
    rows = tq.kept(s, ind.add_panel(daily).where("_used").drop("_used"), "panel")
    path = scratch_path(s, "artefact")
    tr.train_and_report(tr.training_frame(trades, rows), WIDE, path)
    last = rows.where(F.col("date") >= since)
    found = tr.score_candidates(s, path, last)
    return found.groupBy("predicted_bin_rel", "predicted_bin_abs").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 6).alias("mean_prediction"))


TRIALS = 30
def _tuned(s: SparkSession, d: str, variants: dict) -> tuple:
    """Ledgers of the trials for each distinct way to filter entries, the buckets and the windows."""
    rows = bars(s, d)
    way = {n: over["enabled"] and over["mode"] == "soft_filter" for n, over in variants.items()}  # the others only change scores of candidates, not trades
    ways = {way[n]: cf.DEFAULT.merged({"valuation": over}) for n, over in reversed(variants.items())}
    state = tq.kept(s, sq.state(s, d), "state")
    # a code's windows are made before rows go to their days, and rows go there only where a way asks for the day's valuation ranks
    line = W.partitionBy("code").orderBy("date")
    panel = ind.folded_panel(rows.withColumn("_rn", F.row_number().over(line)), (*(x for x in ind.ROLLING if x in sg.SIGNALS_READ or x == "boll_bw"), *sg.RECURSIVE, "psar"), ("_rn", "open", "high", "low", "close", "pb_mrq", "ps_ttm"), sg.windows_of())
    panel = sg.add_valuation_ranks(panel).drop("value_score") if any(way.values()) else panel
    trades = ml.ledgers_in_one_pass(panel.drop("high", "low", "pb_mrq", "ps_ttm"), state, ml.sample_configs(TRIALS), tuple(ways.values()))
    trades = tq.kept(s, trades.drop(*bt.VALUES), "trials")
    made = {w: trades.where(F.col("way") == k).drop("way") for k, w in enumerate(ways)}
    variants = {n: made[way[n]] for n in variants}
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    return variants, buckets.monthly_freeze(rows, "size", 3), lb.walk_windows(s, first, last, train=6, val=3, test=3, step=3)


def tuning(s: SparkSession, d: str) -> DataFrame:
    """The best of 30 random settings for each walk-forward window and size bucket."""
    ledgers, cut, windows = _tuned(s, d, {"baseline": cf.VALUATION_VARIANTS["baseline"]})
    found = ml.tune(ledgers["baseline"], cut, windows, TRIALS)
    return rounded(found, ["hit_rate", "expectancy", "selection_score"], ("window_id", "bucket_id", "trial", "trade_count"))


def walkforward_tuned(s: SparkSession, d: str) -> DataFrame:
    """Test metrics of the six valuation variants with tuned settings."""
    ledgers, cut, windows = _tuned(s, d, cf.VALUATION_VARIANTS)
    tuned = tq.kept(s, ml.tune(ledgers["baseline"], cut, windows, TRIALS), "tuned")
    found = ml.tuned_walk_forward(ledgers, tuned, cut, windows)
    return rounded(found, ["hit_rate", "expectancy", "avg_hold_days"], ("window_id", "variant", "test_start", "test_end", "trade_count"))


register("ml_regressor", regressor)
register("ml_classifier_gbt", classifier("gbt"))
register("ml_classifier_logistic", classifier("logistic"))
register("ml_classifier_mlp", sequence_classifier)
register("ml_quantile", quantiles)
register("train_report", train_report)
register("tuning", tuning)
register("walkforward_tuned", walkforward_tuned)
_wf = ["hit_rate", "expectancy", "avg_hold_days"]
_walk_parts = [p for p in lq._walk.parts if p not in tq._sim.parts]
_sim = tq._sim.table("SELECT * FROM {t}", "trades")
_chain = type(_sim)([*_sim.parts, *_walk_parts], "trades")
register("walkforward_metrics", lambda s, d: rounded(ml.walk_forward(tq.ledger(s, d), lq.walk(s, d)), _wf, ("window_id", "test_start", "test_end", "trade_count")),
         _chain.end("SELECT window_id, test_start, test_end, count(code) AS trade_count, round(avg((pnl_pct > 0)::INT), 6) AS hit_rate, round(avg(pnl_pct), 6) AS expectancy, round(avg(date_diff('day', entry_date, exit_date)), 6) AS avg_hold_days FROM walk LEFT JOIN trades ON entry_date >= test_start AND entry_date < test_end GROUP BY 1, 2, 3"))


def fetched(s: SparkSession, d: str) -> DataFrame:
    """The bars with what a service has of each code since its last one, up to two weeks after the newest: rows, new rows and days of each code."""
    have = bars(s, d).select(F.col("code").cast("string").alias("code"), "date", "close")
    end = have.agg(F.date_add(F.max("date"), 14)).first()[0].isoformat()
    fresh = tq.kept(s, remote.missing_bars(have, end), "fetched")
    every = have.withColumn("new", F.lit(0)).unionByName(fresh.select("code", "date", "close", F.lit(1).alias("new")))
    return every.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("fetched"), F.min(F.when(F.col("new") == 1, F.col("date"))).alias("first_new"), F.max("date").alias("last"))


register("remote_bars", fetched, o.Chain().table("SELECT CAST(code AS VARCHAR) AS code, count(*) AS n, max(date) AS last FROM {t} GROUP BY 1", "own", True).table(
    "SELECT code, CAST(day AS DATE) AS day FROM (SELECT code, unnest(generate_series(last + INTERVAL 1 DAY, (SELECT max(last) FROM own) + INTERVAL 14 DAY, INTERVAL 1 DAY)) AS day FROM own) WHERE isodow(day) < 6", "fresh").end(
    "SELECT o.code, o.n + count(day) AS n, count(day) AS fetched, min(day) AS first_new, coalesce(max(day), o.last) AS last FROM own o LEFT JOIN fresh f USING (code) GROUP BY o.code, o.n, o.last"))


def stream_positions(s: SparkSession, d: str) -> DataFrame:
    """Orders of the keyed stream over the daily predictions, a file a year; every seventh code is held, or waits for its entry, before."""
    preds = tq.risk_preds(s, d)
    rows = tq.kept(s, ps.with_top(preds, bt.top_prefix(bt.candidate_pool(bt.add_risk(preds)))).select("code", "date", "open", "pred_mae", "on_top"), "ranked")
    first = rows.agg(F.min("date")).first()[0]
    held = rows.select("code").distinct().where("code % 7 = 0").select(
        "code", F.when(F.col("code") % 2 == 0, "OPEN").otherwise("PENDING_ENTRY").alias("status"), F.date_sub(F.lit(first), 1).alias("since"), F.when(F.col("code") % 2 == 0, 1).otherwise(0).alias("out_counter"))
    inbox = scratch_path(s, "inbox")
    for (year,) in sorted(rows.select(F.year("date")).distinct().collect()):
        rows.where(F.year("date") == year).coalesce(1).write.mode("append").parquet(inbox)
    return ps.run_to_end(s, inbox, rows.schema, scratch_path(s, "orders"), scratch_path(s, "offsets"), held)


_state = o.Chain(tq._prefix.parts, tq._risk.at).table(
    f"""SELECT x.code, x.date, x.open, x.pred_mae >= -0.08 AS safe, x.pred_mae < -0.08 AS broken, p.code IS NOT NULL AS top, row_number() OVER (PARTITION BY x.code ORDER BY x.date) AS rn
    FROM {{t}} x LEFT JOIN {tq._prefix.at} p ON p.code = x.code AND p.date = x.date""", "pd", True).table(
    """SELECT code, 0::BIGINT AS rn, CASE WHEN code % 7 = 0 THEN CASE WHEN code % 2 = 0 THEN 'OPEN' ELSE 'PENDING' END END AS st, (SELECT min(date) - 1 FROM pd) AS since, CASE WHEN code % 7 = 0 AND code % 2 = 0 THEN 1 ELSE 0 END AS out_,
           NULL::VARCHAR AS side, NULL::VARCHAR AS reason, NULL::DOUBLE AS price, NULL::DATE AS date, NULL::DATE AS lapsed FROM (SELECT DISTINCT code FROM pd)
    UNION ALL
    SELECT code, rn, CASE WHEN fill THEN 'OPEN' WHEN st2 = 'OPEN' THEN CASE WHEN why IS NULL THEN 'OPEN' END WHEN top AND safe THEN 'PENDING' END,
           CASE WHEN fill OR (st2 IS NULL AND top AND safe) THEN date WHEN st2 = 'OPEN' AND why IS NULL THEN since END,
           CASE WHEN fill THEN CASE WHEN top THEN 0 ELSE 1 END WHEN st2 = 'OPEN' AND why IS NULL THEN out2 ELSE 0 END,
           CASE WHEN fill THEN 'BUY' WHEN why IS NOT NULL THEN 'SELL' END, CASE WHEN fill THEN 'enter_topcap' ELSE why END, open, date, CASE WHEN late THEN since + 7 END
    FROM (SELECT *, CASE WHEN st2 = 'OPEN' AND NOT fill THEN CASE WHEN broken THEN 'risk_hard_stop' WHEN out2 >= 2 THEN 'out_of_topcap' END END AS why
          FROM (SELECT *, CASE WHEN late OR fill THEN NULL ELSE st END AS st2, CASE WHEN top THEN 0 ELSE out_ + 1 END AS out2
                FROM (SELECT x.code, x.rn, x.date, x.open, x.safe, x.broken, x.top, l.st, l.since, l.out_, coalesce(l.st = 'PENDING' AND x.date - l.since <= 7, false) AS fill, coalesce(l.st = 'PENDING' AND x.date - l.since > 7, false) AS late
                      FROM ps l JOIN pd x ON x.code = l.code AND x.rn = l.rn + 1)))""", "ps")  # fmt: skip
register("stream_positions", stream_positions, _state.end("""SELECT code, date, side, reason, price FROM ps WHERE side IS NOT NULL
    UNION ALL SELECT code, lapsed, 'CANCEL', 'entry_lapsed', NULL FROM ps WHERE lapsed IS NOT NULL
    UNION ALL SELECT code, since + 7, 'CANCEL', 'entry_lapsed', NULL FROM (SELECT code, max_by(st, rn) AS st, max_by(since, rn) AS since FROM (SELECT code, rn, coalesce(st, '') AS st, coalesce(since, DATE '1900-01-01') AS since FROM ps) GROUP BY code)
    WHERE st = 'PENDING' AND since + 7 < (SELECT max(date) FROM pd)"""))
