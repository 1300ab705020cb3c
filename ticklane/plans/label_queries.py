"""Queries of labels, windows, metrics, joins by key sets, incremental updates and event windows."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.functions import indicators as ind
from ticklane.functions import lookback
from ticklane.operators import labels as lb
from ticklane.operators import metrics as mt
from ticklane.operators import training
from ticklane.plans import oracle as o
from ticklane.plans.indicator_queries import bars, rounded
from ticklane.plans.trade_queries import SQL_PRED, _predictions
from ticklane.sources import bars as src
from ticklane.sources import sinks
from ticklane.sources.scratch import scratch_path
from ticklane.streaming import events as ev
from ticklane.streaming import incremental as inc

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE[name] = sql


start = o.Chain()

# ---- labels and windows ----------------------------------------------------------------------------------------------

register("next_open", lambda s, d: lb.next_open(bars(s, d)).select("code", "date", "next_open", "next_date"), start.end(f"SELECT code, date, {o.lead('open')} AS next_open, {o.lead('date')} AS next_date FROM {{t}}"))
_flat = [f"day{k}_{x}" for k in range(1, 8) for x in ("close", "volume")]
register("dayn_windows", lambda s, d: lb.dayn_windows(bars(s, d), ["close", "volume"]).select("code", "date", *_flat),
         start.add(**{f"day{k}_{x}": o.lag(x, 7 - k) if k < 7 else x for k in range(1, 8) for x in ("close", "volume")}).end("SELECT code, date, " + ", ".join(_flat) + " FROM {t} WHERE rn >= 7"))
register("dayn_aligned", lambda s, d: lb.align(lb.dayn_windows(bars(s, d), ["close"], 3), ["day1_close", "day3_close", "day2_missing"]),
         start.add(day1_close=o.lag("close", 2), day3_close="close").end("SELECT code, date, day1_close, day3_close, CAST(NULL AS DOUBLE) AS day2_missing FROM {t} WHERE rn >= 3"))
register("label_updown", lambda s, d: lb.label_updown(bars(s, d), 5, 0.03).select("code", "date", "label"),
         start.add(top=f"max(close) {o.ahead(5)}", last=o.lead("close", 5)).end("SELECT code, date, CASE WHEN top >= close * 1.03 THEN 1 ELSE 0 END AS label FROM {t} WHERE last IS NOT NULL"))
_fc = [f"close_t{k}" for k in range(1, 6)]
register("future_close", lambda s, d: lb.future_close(bars(s, d)).select("code", "date", *_fc), start.add(**{f"close_t{k}": o.lead("close", k) for k in range(1, 6)}).end("SELECT code, date, " + ", ".join(_fc) + " FROM {t}"))
_fs = ["fwd_max", "fwd_min", "fwd_mean"]
register("fwd_stats", lambda s, d: rounded(lb.forward_stats(bars(s, d)), _fs), start.add(fwd_max=f"max(close) {o.ahead(30)}", fwd_min=f"min(close) {o.ahead(30)}", fwd_mean=f"avg(close) {o.ahead(30)}").show(_fs))
register("fwd_maxret_compat", lambda s, d: rounded(lb.fwd_maxret_compat(bars(s, d)), ["fwd_maxret_compat"]),
         start.add(fwd_maxret_compat=f"CASE WHEN {o.lead('close')} IS NOT NULL THEN max(close) OVER ({o.LINE} ROWS BETWEEN 18 PRECEDING AND 1 FOLLOWING) END / close - 1").show(["fwd_maxret_compat"]))
register("ret_mae_labels", lambda s, d: rounded(lb.ret_mae(bars(s, d)), ["ret_20", "mae_20"]),
         start.add(ret_20=f"{o.lead('close', 20)} / {o.lead('open')} - 1", mae_20=f"CASE WHEN count(low) {o.ahead(20)} = 20 THEN min(low) {o.ahead(20)} END / {o.lead('open')} - 1").show(["ret_20", "mae_20"]))
_cs = start.add(fwd=f"{o.lead('close', 21)} / close - 1").table("SELECT date, quantile_cont(fwd, 0.1) AS lo, quantile_cont(fwd, 0.9) AS hi FROM {t} GROUP BY date HAVING count(fwd) >= 5", "cuts")
register("cs_quantile_label", lambda s, d: lb.cs_quantile_label(bars(s, d), least=5).select("code", "date", "label"), _cs.end("SELECT code, date, CASE WHEN fwd >= hi THEN 2 WHEN fwd <= lo THEN 0 WHEN fwd IS NOT NULL AND hi IS NOT NULL THEN 1 END AS label FROM {t} LEFT JOIN cuts USING (date)"))
_tb = start.add(hs=f"list(high) {o.ahead(21)}", ls=f"list(low) {o.ahead(21)}").add(
    u="coalesce(list_position(list_transform(hs, lambda x: x / (close + 1e-12) - 1 >= 0.10), true), 0)", dn="coalesce(list_position(list_transform(ls, lambda x: x / (close + 1e-12) - 1 <= -0.08), true), 0)")
register("triple_barrier", lambda s, d: lb.triple_barrier(bars(s, d)).select("code", "date", "label"),
         _tb.end("SELECT code, date, CASE WHEN hs IS NULL THEN NULL WHEN u = 0 AND dn = 0 THEN 1 WHEN dn = 0 THEN 2 WHEN u = 0 THEN 0 WHEN u = dn THEN 1 WHEN u < dn THEN 2 ELSE 0 END AS label FROM {t}"))
register("seq_samples", lambda s, d: lb.sequences(bars(s, d), ["close", "volume"], 5).select("code", "date", F.round(F.aggregate(F.transform("seq", lambda x, i: x[0] * (i + 1) + x[1] / 1000), F.lit(0.0), lambda a, x: a + x), 6).alias("digest")),
         start.add(digest=" + ".join(f"{o.lag('close', 4 - i) if i < 4 else 'close'} * {i + 1} + {o.lag('volume', 4 - i) if i < 4 else 'volume'} / 1000" for i in range(5))).show(["digest"], "rn >= 5"))
register("time_split", lambda s, d: lb.time_split(bars(s, d), 126).select("code", "date", "is_valid"), start.end("SELECT code, date, date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 126)) AS is_valid FROM {t}"))


def walk(s: SparkSession, d: str) -> DataFrame:
    span = bars(s, d).agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return lb.walk_windows(s, span.a, span.b)


_walk = start.table("SELECT min(date) AS a, max(date) AS b FROM {t}", "span").table(
    "SELECT 0 AS window_id, a AS train_start FROM span UNION ALL SELECT window_id + 1, CAST(train_start + INTERVAL 3 MONTH AS DATE) FROM ww WHERE window_id < 400", "ww").table(
    "SELECT *, CAST(train_start + INTERVAL 12 MONTH AS DATE) AS val_start FROM ww", "w1").table("SELECT *, CAST(val_start + INTERVAL 3 MONTH AS DATE) AS test_start FROM w1", "w2").table(
    "SELECT *, CAST(test_start + INTERVAL 3 MONTH AS DATE) AS test_end FROM w2", "w3").table("SELECT * FROM w3 WHERE test_end <= (SELECT b FROM span)", "walk")
register("walk_windows", walk, _walk.end("SELECT window_id, train_start, val_start, test_start, test_end FROM walk"))
register("window_slices", lambda s, d: lb.window_slices(bars(s, d), walk(s, d), "test_start", "test_end").groupBy("window_id", "code").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("close"), 6).alias("mean_close")),
         _walk.end("SELECT window_id, code, count(*) AS n, round(avg(close), 6) AS mean_close FROM bars JOIN walk ON date >= test_start AND date < test_end GROUP BY 1, 2"))
register("prev_probs", lambda s, d: rounded(_predictions(bars(s, d)).withColumns(lb.previous(_predictions(bars(s, d)), "pred", 3)), ["pred_0", "pred_1", "pred_2"]),
         start.add(pred=SQL_PRED).add(pred_0="pred", pred_1=o.lag("pred", 1), pred_2=o.lag("pred", 2)).show(["pred_0", "pred_1", "pred_2"]))

# ---- classifier metrics over labelled documents ------------------------------------------------------------------------


def probs(s: SparkSession, d: str) -> DataFrame:
    """y and a stand-in probability of each labelled document."""
    t = s.read.parquet(f"{d}/labels.parquet")
    return t.select("doc_id", F.col("quality").cast("long").alias("y"), ((F.pmod(F.col("doc_id") * 7919, F.lit(1000)) + 400 * F.col("quality")) / 1400.0).alias("prob"))


PROBS = "SELECT doc_id, CAST(quality AS BIGINT) AS y, (((doc_id * 7919) % 1000) + 400 * quality) / 1400.0 AS prob FROM labels"
_scan = f"""WITH p AS ({PROBS}), g AS (SELECT k, k / 100.0 AS th FROM range(0, 101) r(k)),
m AS (SELECT k, sum((floor(round(prob * 100, 9)) >= k AND y = 1)::BIGINT)::BIGINT AS tp, sum((floor(round(prob * 100, 9)) >= k AND y = 0)::BIGINT)::BIGINT AS fp, sum(y)::BIGINT AS pp, sum(1 - y)::BIGINT AS nn FROM g, p GROUP BY k),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(pp, 0), 0) AS recall FROM m)
SELECT round(k / 100.0, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, tp, fp, nn - fp AS tn, pp - tp AS fn, tp + fp AS pred_pos FROM q"""
register("threshold_scan", lambda s, d: rounded(mt.threshold_scan(probs(s, d)), ["precision", "recall", "f1"], ("threshold", "tp", "fp", "tn", "fn", "pred_pos")), _scan)
register("eval_probs", lambda s, d: rounded(mt.eval_probs(probs(s, d)), ["roc_auc", "average_precision", "precision", "recall", "f1"], ()),
         f"""WITH p AS ({PROBS}), r AS (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS k, sum(y) OVER (ORDER BY prob DESC) / count(*) OVER (ORDER BY prob DESC) AS prec FROM p),
         a AS (SELECT sum(y) AS pp, count(*) AS n, sum(CASE WHEN y = 1 THEN k END) AS s, sum(CASE WHEN y = 1 THEN prec END) AS ap, sum((prob >= 0.5 AND y = 1)::INT) AS tp, sum((prob >= 0.5)::INT) AS pos FROM r),
         b AS (SELECT *, tp / pos AS precision, tp / pp AS recall FROM a)
         SELECT round((s - pp * (pp + 1) / 2) / (pp * (n - pp)), 6) AS roc_auc, round(ap / pp, 6) AS average_precision, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM b""")  # fmt: skip
register("class_weights", lambda s, d: rounded(mt.class_weights(probs(s, d)), ["weight"], ("y", "n")), f"WITH p AS ({PROBS}) SELECT y, count(*) AS n, round((SELECT count(*) FROM p) / ((SELECT count(DISTINCT y) FROM p) * count(*)), 6) AS weight FROM p GROUP BY y")
_cm = ["accuracy", "balanced_accuracy", "f1_up", "confidence", "margin", "entropy"]
register("class_metrics", lambda s, d: rounded(mt.class_metrics(probs(s, d).withColumn("probs", F.array(1 - F.col("prob"), F.col("prob")))), _cm, ()),
         f"""WITH p AS (SELECT *, CASE WHEN prob > 1 - prob THEN 1 ELSE 0 END AS pr, greatest(prob, 1 - prob) AS cf, abs(2 * prob - 1) AS mg,
             (CASE WHEN prob > 0 THEN -prob * ln(prob) ELSE 0 END + CASE WHEN prob < 1 THEN -(1 - prob) * ln(1 - prob) ELSE 0 END) / ln(2) AS en FROM ({PROBS}))
         SELECT round(avg((y = pr)::INT), 6) AS accuracy, round((SELECT avg(a) FROM (SELECT avg((y = pr)::INT) AS a FROM p GROUP BY y)), 6) AS balanced_accuracy, round(2 * sum((y = 1 AND pr = 1)::INT) / (sum(y) + sum(pr)), 6) AS f1_up,
         round(avg(cf), 6) AS confidence, round(avg(mg), 6) AS margin, round(avg(en), 6) AS entropy FROM p""")  # fmt: skip
register("prob_ranges", lambda s, d: rounded(mt.prob_ranges(probs(s, d), [(0.0, 0.3), (0.25, 0.75), (0.9, 1.0)]), ["prob"], ("doc_id", "range")),
         f"SELECT doc_id, range, round(prob, 6) AS prob FROM ({PROBS}) JOIN (VALUES (0.0::DOUBLE, 0.3::DOUBLE, '0-0.3'), (0.25, 0.75, '0.25-0.75'), (0.9, 1.0, '0.9-1')) v(lo, hi, range) ON prob BETWEEN lo AND hi")
register("high_conf", lambda s, d: rounded(probs(s, d).withColumn("y_pred", (F.col("prob") >= 0.84).cast("int")).where("y_pred = 1").orderBy(F.col("prob").desc(), "doc_id"), ["prob"], ("doc_id", "y_pred")), f"SELECT doc_id, 1 AS y_pred, round(prob, 6) AS prob FROM ({PROBS}) WHERE prob >= 0.84")


def preds(s: SparkSession, d: str) -> DataFrame:
    """pred and y = the next five rows' return."""
    from ticklane.functions.base import lead

    return _predictions(bars(s, d)).withColumn("y", lead("close", 5) / F.col("close") - 1).where("y IS NOT NULL")


_preds = start.add(pred=SQL_PRED, y=f"{o.lead('close', 5)} / close - 1").table("SELECT * FROM {t} WHERE y IS NOT NULL")
_rg = {"mae": "avg(abs(y - pred))", "rmse": "sqrt(avg((y - pred) ** 2))", "r2": "1 - sum((y - pred) ** 2) / (var_pop(y) * count(*))", "pearson": "corr(y, pred)", **{f"q{q}": f"quantile_cont(pred, {q / 100})" for q in (20, 40, 60, 80)}, "pred_mean": "avg(pred)", "pred_std": "stddev_pop(pred)"}
register("regression_metrics", lambda s, d: rounded(mt.regression_metrics(preds(s, d)), list(_rg), ()), _preds.end("SELECT " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _rg.items()) + " FROM {t}"))
register("quantile_metrics", lambda s, d: rounded(mt.quantile_metrics(preds(s, d), 0.7), ["pinball", "coverage", "top_mean"], ()),
         _preds.end("SELECT round(avg(greatest(0.7 * (y - pred), (0.7 - 1) * (y - pred))), 6) AS pinball, round(avg((y <= pred)::INT), 6) AS coverage, round(avg(y) FILTER (WHERE pred >= (SELECT quantile_cont(pred, 0.9) FROM {t})), 6) AS top_mean FROM {t}"))
_qr = ["mean", "median", "win_rate", "avg_win", "avg_loss"]
register("quintile_report", lambda s, d: rounded(mt.quintile_report(preds(s, d), tie=["code", "date"]), _qr, ("bin", "n")),
         _preds.table("SELECT *, 1 + (SELECT count(*) FROM range(1, 5) g(j) WHERE (r - 1) * 5 > (n - 1) * j) AS bin FROM (SELECT y, pred, row_number() OVER (ORDER BY pred, code, date) AS r, count(*) OVER () AS n FROM {t})")
         .end("SELECT bin, count(*) AS n, round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(avg((y > 0)::INT), 6) AS win_rate, round(coalesce(avg(y) FILTER (WHERE y > 0), 0), 6) AS avg_win, round(coalesce(avg(y) FILTER (WHERE y <= 0), 0), 6) AS avg_loss FROM {t} GROUP BY bin"))
CUTS = [-0.02, -0.005, 0.005, 0.02]
register("assign_bins", lambda s, d: preds(s, d).select("code", "date", mt.assign_bins("pred", CUTS).alias("bin")), _preds.end("SELECT code, date, CASE WHEN pred IS NULL THEN 0 " + " ".join(f"WHEN pred <= {x} THEN {k + 1}" for k, x in enumerate(CUTS)) + " ELSE 5 END AS bin FROM {t}"))


def saved_bins(s: SparkSession, d: str) -> DataFrame:
    """Bins whose borders were fitted on the rows before 1998, saved as JSON, and applied to the later ones, absolutely and within each day."""
    rows = preds(s, d)
    fitted = json.loads(json.dumps(training.fit_bins(rows.where("date < '1998-01-01'"), "pred")))
    return training.apply_bins(rows.where("date >= '1998-01-01'"), fitted, "pred").select("code", "date", "predicted_bin_abs", "predicted_bin_rel", "predicted_bin")


register("saved_bins", saved_bins,
         _preds.table("SELECT " + ", ".join(f"quantile_cont(pred, {k / 5}) AS c{k}" for k in range(1, 5)) + " FROM {t} WHERE date < DATE '1998-01-01'", "fitted", True).table(
             "SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred, code) AS r, count(*) OVER (PARTITION BY date) AS n FROM {t} WHERE date >= DATE '1998-01-01'")
         .add(rel="1 + " + " + ".join(f"((r - 1) * 5 > (n - 1) * {j})::BIGINT" for j in range(1, 5)), ab="(SELECT 1 + " + " + ".join(f"(pred > c{k})::BIGINT" for k in range(1, 5)) + " FROM fitted)")
         .end("SELECT code, date, ab AS predicted_bin_abs, rel AS predicted_bin_rel, ab AS predicted_bin FROM {t}"))
register("topfrac_hit", lambda s, d: rounded(mt.topfrac_hit(preds(s, d), "pred", "y", 0.2, 0.0, 5), ["topfrac_hit"], ("days",)),
         _preds.table("SELECT date, avg((y > 0)::INT) AS hit FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY pred DESC, code) AS r FROM {t}) WHERE n >= 5 AND r <= greatest(floor(n * 0.2), 1) GROUP BY date")
         .end("SELECT count(*) AS days, round(avg(hit), 6) AS topfrac_hit FROM {t}"))
register("topn_hit", lambda s, d: rounded(mt.topfrac_hit(preds(s, d), "pred", "y", 0.0, 0.0, 1), ["topfrac_hit"], ("days",)),
         _preds.table("SELECT date, max_by((y > 0)::INT, (pred, -code)) AS hit FROM {t} GROUP BY date").end("SELECT count(*) AS days, round(avg(hit), 6) AS topfrac_hit FROM {t}"))
_std = lambda x: f"(({x}) - avg({x}) FILTER (WHERE date < DATE '1998-01-01') OVER ()) / coalesce(nullif(stddev_pop({x}) FILTER (WHERE date < DATE '1998-01-01') OVER (), 0), 1)"
register("standardize", lambda s, d: rounded(mt.standardize(bars(s, d), bars(s, d).where("date < '1998-01-01'"), ["close", "volume"]), ["z_close", "z_volume"]), start.add(z_close=_std("close"), z_volume=_std("volume")).show(["z_close", "z_volume"]))
register("impute_median", lambda s, d: mt.impute_median(bars(s, d), bars(s, d).where("date < '1998-01-01'"), ["pb_mrq", "ps_ttm"]).select("code", "date", "pb_mrq", "ps_ttm"),
         start.end("SELECT code, date, coalesce(pb_mrq, (SELECT median(pb_mrq) FROM bars WHERE date < DATE '1998-01-01')) AS pb_mrq, coalesce(ps_ttm, (SELECT median(ps_ttm) FROM bars WHERE date < DATE '1998-01-01')) AS ps_ttm FROM {t}"))
register("feature_matrix", lambda s, d: mt.feature_matrix(bars(s, d), ["close", "pb_mrq", "absent"]).select("code", "date", "close", "pb_mrq", "absent"), start.end("SELECT code, date, close, coalesce(pb_mrq, 0.0) AS pb_mrq, 0.0::DOUBLE AS absent FROM {t}"))
register("unit_repair", lambda s, d: rounded(mt.unit_repair(bars(s, d), "pct_chg"), ["pct_chg"]), start.end("SELECT code, date, round(CASE WHEN (SELECT max(abs(pct_chg)) FROM bars) > 1.5 THEN pct_chg / 100 ELSE pct_chg END, 6) AS pct_chg FROM {t}"))
def _sanitized(s: SparkSession, d: str) -> DataFrame:
    from ticklane.functions.base import finite

    bad = F.when(F.col("code") % 3 == 0, F.lit(float("inf"))).when(F.col("code") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("close"))
    return bars(s, d).select(finite(bad).alias("x"))


register("sanitize", lambda s, d: _sanitized(s, d).agg(F.round(F.avg(F.col("x").isNull().cast("int")), 6).alias("missing"), F.count("x").alias("n")), start.end("SELECT round(avg((code % 3 < 2)::INT), 6) AS missing, sum((code % 3 = 2)::INT)::BIGINT AS n FROM {t}"))

# ---- key sets, incremental updates ---------------------------------------------------------------------------------------


def semi_anti(s: SparkSession, d: str) -> DataFrame:
    """Codes held on the last quarter day, by whether they are on top of it."""
    df = bars(s, d)
    held, top = df.where("code % 2 = 0").select("code").distinct(), df.where("close > 100").select("code").distinct()
    return held.join(top, "code", "left_semi").withColumn("side", F.lit("both")).unionByName(held.join(top, "code", "left_anti").withColumn("side", F.lit("held_only")))


register("semi_anti", semi_anti, start.end("SELECT code, CASE WHEN max(close) > 100 THEN 'both' ELSE 'held_only' END AS side FROM {t} WHERE code % 2 = 0 GROUP BY code"))
register("dedup_last", lambda s, d: src.dedup_last(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"), ["l_orderkey", "l_linenumber"], ["l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]),
         "SELECT * EXCLUDE (k) FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1")
register("high_water", lambda s, d: inc.high_water(bars(s, d)), start.end("SELECT code, max(date) AS last_date FROM {t} GROUP BY code"))
register("incremental_plan", lambda s, d: inc.fetch_plan(bars(s, d).where("code % 4 <> 0"), bars(s, d).select("code").distinct().withColumn("list_date", F.when(F.col("code") % 8 == 0, F.lit("1994-06-01").cast("date"))), "1990-01-01"),
         start.end("SELECT DISTINCT code, CASE WHEN code % 4 <> 0 THEN (SELECT max(date) + 1 FROM bars b WHERE b.code = x.code) WHEN code % 8 = 0 THEN DATE '1994-06-01' ELSE DATE '1990-01-01' END AS start_date FROM {t} x"))


def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    df = bars(s, d).select("code", "date", "close")
    path = scratch_path(s, "bars")
    for rows in (df.where("code % 2 = 0"), df.where("code % 3 = 0").withColumn("close", -F.col("close"))):
        sinks.upsert_months(s, path, rows)
    return sinks.read_months(s, path).select("code", "date", "close")


register("upsert_latest", upsert_latest, start.end("SELECT code, date, CASE WHEN code % 3 = 0 THEN -close ELSE close END AS close FROM {t} WHERE code % 2 = 0 OR code % 3 = 0"))
register("incremental_samples", lambda s, d: inc.new_samples(bars(s, d).select("code", "date", "close"), bars(s, d).where("date < '1998-06-01' AND code % 5 <> 0").select("code", "date")), start.end("SELECT code, date, close FROM {t} WHERE code % 5 = 0 OR date > (SELECT max(b.date) FROM bars b WHERE b.code = {t}.code AND b.date < DATE '1998-06-01')"))

# ---- event windows -------------------------------------------------------------------------------------------------------

_ev = "(SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value FROM events)"
register("ev_tumbling", lambda s, d: ev.tumbling(ev.scan(s, d)), f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {_ev} GROUP BY 1, 2")
register("ev_sliding", lambda s, d: ev.sliding(ev.scan(s, d)), f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS window_start, event_type, count(*) AS n FROM {_ev}, range(0, 2) r(k) GROUP BY 1, 2")
register("ev_session", lambda s, d: ev.sessions(ev.scan(s, d)),
         f"SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM {_ev})) GROUP BY user_id, sid")
register("ev_stream_tumbling", lambda s, d: ev.stream_tumbling(s, d), ORACLE["ev_tumbling"])
register("stream_upsert", lambda s, d: inc.stream_upsert(s, bars(s, d).select("code", "date", "close")), start.end("SELECT code, date, close FROM {t}"))


def listed_equities(s: SparkSession, d: str) -> DataFrame:
    """Reference rows made of the suppliers, scanned for those that are listed."""
    n = F.col("s_suppkey")
    rows = s.read.parquet(f"{d}/supplier.parquet").select(
        F.concat(F.when(n % 2 == 0, "sh.").otherwise("sz"), F.when(n % 10 == 3, ".").otherwise(""), n.cast("string")).alias("code"), F.when(n % 3 == 0, "2").otherwise("1").alias("type"),
        F.when(n % 5 == 0, "0").otherwise("1").alias("status"), F.when(n % 7 == 0, "").otherwise("2001-02-03").alias("ipoDate"))
    return src.listed(rows)


register("listed_equities", listed_equities, "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, CASE WHEN s_suppkey % 7 <> 0 THEN DATE '2001-02-03' END AS ipo_date FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND (s_suppkey % 2 = 0) <> (s_suppkey % 10 = 3)")


def feature_lines(s: SparkSession, d: str) -> DataFrame:
    """A feature list written as text and read again, with the place of each name."""
    path = scratch_path(s, "features")
    names = ["day1_close", "day2_close", " volume ", "", "rsi14"]
    s.createDataFrame([("\n".join(names),)], "value string").coalesce(1).write.text(path)
    return s.createDataFrame(list(enumerate(src.feature_list(s, path))), "place int, feature string")


register("feature_list", feature_lines, "SELECT CAST(place AS INT) AS place, feature FROM (VALUES (0, 'day1_close'), (1, 'day2_close'), (2, 'volume'), (3, 'rsi14')) AS t(place, feature)")
register("missing_rates", lambda s, d: mt.missing_rates(bars(s, d), ["close", "pb_mrq", "ps_ttm"]).withColumn("missing", F.round("missing", 6)),
         start.end(" UNION ALL ".join(f"SELECT '{x}' AS feature, round(avg(({x} IS NULL)::INT), 6) AS missing FROM {{t}}" for x in ("close", "pb_mrq", "ps_ttm"))))
register("calibrated_bins", lambda s, d: preds(s, d).select("code", "date", mt.calibrated_bins("pred", CUTS, 0.002, 0.025).alias("bin")),
         _preds.end("SELECT code, date, CASE WHEN pred IS NULL THEN 0 " + " ".join(f"WHEN (pred - 2e-3) / 25e-3 <= {(x - 0.002) / 0.025!r}::DOUBLE THEN {k + 1}" for k, x in enumerate(CUTS)) + " ELSE 5 END AS bin FROM {t}"))
register("ret_mae_compat", lambda s, d: rounded(lb.ret_mae(bars(s, d), compat=True), ["ret_20", "mae_20"]),
         start.add(ret_20=f"{o.lead('close', 20)} / {o.lead('open')} - 1", mae_20=f"CASE WHEN count(low) OVER ({o.LINE} ROWS BETWEEN 18 PRECEDING AND 1 FOLLOWING) = 20 AND {o.lead('low')} IS NOT NULL THEN min(low) OVER ({o.LINE} ROWS BETWEEN 18 PRECEDING AND 1 FOLLOWING) END / {o.lead('open')} - 1").show(["ret_20", "mae_20"]))
register("dayn_between", lambda s, d: lb.dayn_between(bars(s, d), ["close"], 3, "1995-01-01", "1995-12-31").select("code", "date", "day1_close", "day2_close", "day3_close"),
         start.add(day1_close=o.lag("close", 2), day2_close=o.lag("close", 1), day3_close="close").end("SELECT code, date, day1_close, day2_close, day3_close FROM {t} WHERE rn >= 3 AND date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'"))
register("new_windows", lambda s, d: rounded(inc.new_windows(bars(s, d).select("code", "date", "close"), bars(s, d).where("date < '1998-06-01' AND code % 5 <> 0").select("code", "date"), ["close"], 3, 2, 0.01), ["day1_close", "day2_close", "day3_close"], ("code", "date", "label")),
         start.table("SELECT code, date, close FROM {t} WHERE code % 5 = 0 OR date >= (SELECT max(b.date) - INTERVAL 2 DAY FROM bars b WHERE b.code = {t}.code AND b.date < DATE '1998-06-01')").table(
             f"SELECT *, greatest({o.lead('close', 1)}, {o.lead('close', 2)}) >= close * 1.01 AS up, {o.lead('close', 2)} AS last_ FROM {{t}}").table("SELECT code, date, close, CAST(up AS INT) AS label FROM {t} WHERE last_ IS NOT NULL").table(
             f"SELECT *, {o.lag('close', 2)} AS day1_close, {o.lag('close', 1)} AS day2_close, close AS day3_close, row_number() OVER ({o.LINE}) AS k FROM {{t}}").end(
             "SELECT code, date, label, round(day1_close, 6) AS day1_close, round(day2_close, 6) AS day2_close, round(day3_close, 6) AS day3_close FROM {t} WHERE k >= 3 AND (code % 5 = 0 OR date > (SELECT max(b.date) FROM bars b WHERE b.code = {t}.code AND b.date < DATE '1998-06-01'))"))


def recent_features(s: SparkSession, d: str) -> DataFrame:
    """Features and labels of two months, from a table by day of which only the days that they look at are read."""
    path = scratch_path(s, "by_day")
    bars(s, d).repartitionByRange("date").sortWithinPartitions("date").write.parquet(path)

    def made(rows: DataFrame) -> DataFrame:
        df = ind.add_bollinger(ind.add_rsi(rows)).withColumns({"roc10": ind.roc("close", 10), "rvol20": ind.rvol()})
        return lb.ret_mae(df)

    span = dt.date(1997, 3, 1), dt.date(1997, 4, 30)
    back, ahead = lookback.reach("rsi", "bollinger", "roc10", "rvol", "ret_mae")
    return rounded(lookback.within(s.read.parquet(path), *span, made, back, ahead), _RECENT)


_RECENT = ["rsi14", "boll_bw", "roc10", "rvol20", "ret_20", "mae_20"]
register("recent_features", recent_features, o.add_boll(o.add_rsi(start)).add(
    roc10=o.roc("close", 10), rvol20=o.RVOL, ret_20=f"{o.lead('close', 20)} / {o.lead('open')} - 1",
    mae_20=f"CASE WHEN count(low) {o.ahead(20)} = 20 THEN min(low) {o.ahead(20)} END / {o.lead('open')} - 1").show(_RECENT, "date BETWEEN DATE '1997-03-01' AND DATE '1997-04-30'"))
