"""Model metrics: threshold scans, AUC and average precision, class metrics, regression and quantile metrics, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane.functions.base import c, div
from ticklane.functions.quantiles import exact_quantiles, few_rows
from ticklane.functions.totals import running_totals
from ticklane.operators.buckets import qcut
from ticklane.sources.scratch import written


def threshold_scan(df: DataFrame, y: str = "y", p: str = "prob", steps: int = 100) -> DataFrame:
    """Confusion counts, precision, recall and F1 at thresholds 0, 1/steps, ..., 1 (a row is positive at prob >= threshold).

    Probabilities are first counted by the highest threshold they reach; what is scanned is at most steps + 1 rows.
    """
    hit = F.floor(F.round(c(p) * steps, 9)).cast("int")
    counts = df.groupBy(hit.alias("k")).agg(F.sum(c(y)).alias("pos"), F.sum(1 - c(y)).alias("neg"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    counts = grid.join(counts, "k", "left").fillna(0)
    down = W.orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(F.lit(0))
    df = counts.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "_p": F.sum("pos").over(every), "_n": F.sum("neg").over(every)})
    df = df.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp"), "pred_pos": F.col("tp") + F.col("fp"), "threshold": F.round(F.col("k") / steps, 6)})
    df = df.withColumns({"precision": F.coalesce(div(c("tp").cast("double"), c("pred_pos").cast("double")), F.lit(0.0)), "recall": F.coalesce(div(c("tp").cast("double"), c("_p").cast("double")), F.lit(0.0))})
    f1 = F.coalesce(div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return df.withColumn("f1", f1).select("threshold", "precision", "recall", "f1", "tp", "fp", "tn", "fn", "pred_pos")


def best_threshold(scan: DataFrame, strategy: str = "f1", target: float = 0.5) -> DataFrame:
    """The row of best F1, or of best F1 among those that reach the target precision or recall (of all if none does)."""
    ok = F.lit(True) if strategy == "f1" else F.col(strategy) >= target
    return scan.orderBy(ok.desc(), F.col("f1").desc(), F.col("threshold")).limit(1)


def eval_probs(df: DataFrame, y: str = "y", p: str = "prob", threshold: float = 0.5) -> DataFrame:
    """One row: exact ROC-AUC (mean ranks for ties), average precision, and precision, recall, F1 at the threshold.

    Rows are first counted by probability; running sums over the distinct ones are made range by range.
    """
    prob = F.greatest(F.least(F.coalesce(F.nanvl(c(p), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    by = df.groupBy(prob.alias("p")).agg(F.sum(c(y).cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    whole = by.agg(F.sum("pos").alias("_P"), F.sum("n").alias("_N"))  # one row
    by = running_totals(by, "p", {"_below": "n", "_before": "pos"}).join(F.broadcast(whole), F.lit(True), "inner")
    by = by.withColumns({"_tp": F.col("_P") - F.col("_before"), "_pp": F.col("_N") - F.col("_below")})
    at = lambda x: F.sum(F.when(F.col("p") >= threshold, F.col(x)).otherwise(0.0))
    sums = by.agg(
        F.sum("pos").alias("P"), F.sum("n").alias("N"), F.sum(F.col("pos") * (F.col("_below") + (F.col("n") + 1) / 2)).alias("ranks"),
        F.sum(F.col("pos") * F.col("_tp") / F.col("_pp")).alias("ap"), at("pos").alias("tp"), at("n").alias("pp"))
    precision, recall = F.coalesce(div("tp", "pp"), F.lit(0.0)), F.coalesce(div("tp", "P"), F.lit(0.0))
    return sums.select(
        div(F.col("ranks") - F.col("P") * (F.col("P") + 1) / 2, F.col("P") * (F.col("N") - F.col("P"))).alias("roc_auc"), div("ap", "P").alias("average_precision"),
        precision.alias("precision"), recall.alias("recall"), F.coalesce(div(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Balanced weight of each class: n / (classes * n_class)."""
    every = W.partitionBy(F.lit(0))
    counts = df.groupBy(c(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("y", "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def class_metrics(df: DataFrame, y: str = "y", probs: str = "probs") -> DataFrame:
    """One row: accuracy, balanced accuracy, F1 of the highest class, mean confidence, margin and normalised entropy. probs: array per class."""
    pred = F.array_position(c(probs), F.array_max(c(probs))).cast("int") - 1
    ordered = F.sort_array(c(probs), asc=False)
    entropy = F.aggregate(c(probs), F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0)) / F.log(F.size(c(probs)).cast("double"))
    rows = df.select(c(y).alias("y"), pred.alias("pred"), F.array_max(c(probs)).alias("conf"), (ordered[0] - ordered[1]).alias("margin"), entropy.alias("entropy"), (F.size(c(probs)) - 1).alias("top"))
    rows = rows.join(F.broadcast(rows.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))), "y")  # a row a class
    ok = (F.col("y") == F.col("pred")).cast("double")
    both = F.sum(((F.col("y") == F.col("top")) & (F.col("pred") == F.col("top"))).cast("double"))
    sides = F.sum((F.col("y") == F.col("top")).cast("double")) + F.sum((F.col("pred") == F.col("top")).cast("double"))
    return rows.agg(F.avg(ok).alias("accuracy"), (F.sum(ok / F.col("_n")) / F.count_distinct("y")).alias("balanced_accuracy"), F.coalesce(div(2 * both, sides), F.lit(0.0)).alias("f1_up"), F.avg("conf").alias("confidence"), F.avg("margin").alias("margin"), F.avg("entropy").alias("entropy"))


def regression_metrics(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    df = written(df.select(c(y).alias("y"), c(p).alias("p")), "predictions")
    e, cuts = c("y") - c("p"), (20, 40, 60, 80)
    found = exact_quantiles(df, {"p": [q / 100 for q in cuts]})[None, "p"]
    return df.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop("y") * F.count("y"))).alias("r2"), F.corr("y", "p").alias("pearson"),
        *[F.lit(x).cast("double").alias(f"q{q}") for q, x in zip(cuts, found, strict=True)], F.avg("p").alias("pred_mean"), F.stddev_pop("p").alias("pred_std"))


def quantile_metrics(df: DataFrame, q: float, y: str = "y", p: str = "pred", top: float = 0.1) -> DataFrame:
    """Pinball loss, share of y under the prediction, mean y of the top share by prediction."""
    df = written(df.select(c(y).alias("y"), c(p).alias("p")), "predictions")
    e, cut = c("y") - c("p"), exact_quantiles(df, {"p": [1 - top]})[None, "p"][0]
    return df.agg(F.avg(F.greatest(q * e, (q - 1) * e)).alias("pinball"), F.avg((c("y") <= c("p")).cast("double")).alias("coverage"), F.avg(F.when(c("p") >= F.lit(cut).cast("double"), c("y"))).alias("top_mean"))


def quintile_report(df: DataFrame, y: str = "y", p: str = "pred", k: int = 5, tie: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Statistics of y in bins of the prediction's place; by: few further groups."""
    rows = written(qcut(df, p, k, tie=tie), "bins")
    v, keys = c(y), ["bin", *(by or [])]
    named = rows.withColumn("_g", F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in keys]))
    middle = few_rows(df.sparkSession, exact_quantiles(named.select("_g", v.alias("_y")), {"_y": [0.5]}, "_g"), "_y", ["_median"], "_g", "string")
    return named.join(F.broadcast(middle), "_g", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.max("_median").alias("median"), F.avg((v > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(v <= 0, v)), F.lit(0.0)).alias("avg_loss"))


def assign_bins(x, cuts: list[float]):
    """1 .. len(cuts) + 1 by thresholds (x <= cut belongs below), 0 if unknown."""
    bin_ = F.lit(len(cuts) + 1)
    for k in range(len(cuts), 0, -1):
        bin_ = F.when(c(x) <= cuts[k - 1], k).otherwise(bin_)
    return F.when(c(x).isNull(), 0).otherwise(bin_)


def calibrated_bins(x, cuts: list[float], mean: float, std: float):
    """assign_bins of the standardised value among the standardised cuts, for cuts and statistics of a training run; plain bins
    without a deviation."""
    if not std:
        return assign_bins(x, cuts)
    return assign_bins((c(x) - mean) / std, [(k - mean) / std for k in cuts])


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, missing: the share of each column's cells that are null, NaN or infinite, the worst first; one scan."""
    gone = lambda x: F.avg((F.col(x).isNull() | F.isnan(F.col(x).cast("double")) | (F.abs(F.col(x).cast("double")) == float("inf"))).cast("double"))
    rates = df.agg(*[gone(x).alias(x) for x in columns]).unpivot([], columns, "feature", "missing")
    return rates.orderBy(F.col("missing").desc(), "feature")


def topfrac_hit(df: DataFrame, score: str, ret: str, fraction: float = 0.1, threshold: float = 0.0, least: int = 50) -> DataFrame:
    """Mean over days of the hit rate among a day's top fraction by score; days with fewer than ``least`` rows are left out."""
    day = W.partitionBy("date")
    rows = df.withColumns({"_n": F.count(F.lit(1)).over(day), "_r": F.row_number().over(day.orderBy(c(score).desc(), "code"))}).where(F.col("_n") >= least)
    rows = rows.where(F.col("_r") <= F.greatest(F.floor(F.col("_n") * fraction), F.lit(1)))
    days = rows.groupBy("date").agg(F.avg((c(ret) > threshold).cast("double")).alias("hit"))
    return days.agg(F.count(F.lit(1)).alias("days"), F.avg("hit").alias("topfrac_hit"))


def fit_standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: mean and population deviation (null or 0 counts as 1); one scan."""
    one = lambda x: F.struct(F.lit(x).alias("feature"), F.avg(x).alias("mean"), F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0)).alias("std"))
    return df.agg(F.array(*[one(x) for x in columns]).alias("_rows")).select(F.inline("_rows"))


def standardize(df: DataFrame, fitted_on: DataFrame, columns: list[str]) -> DataFrame:
    """z_x for each column; the statistics are one row, joined by broadcast."""
    stats = fitted_on.agg(*[e for x in columns for e in (F.avg(x).alias(f"_m_{x}"), F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{x}"))])
    df = df.join(F.broadcast(stats), F.lit(True), "inner")
    return df.withColumns({f"z_{x}": (c(x) - c(f"_m_{x}")) / c(f"_s_{x}") for x in columns}).drop(*stats.columns)


def impute_median(df: DataFrame, fitted_on: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls filled by the exact medians of another frame."""
    found = exact_quantiles(fitted_on, {x: [0.5] for x in columns})
    return df.withColumns({x: F.coalesce(c(x), F.lit(found[None, x][0]).cast("double")) for x in columns})


def equity_curve(trades: DataFrame, by: list[str], order: list[str], pnl: str = "pnl_pct") -> DataFrame:
    """Compounded equity, its peak, the drawdown and the worst one so far."""
    line = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    df = trades.withColumn("equity", F.product(1 + c(pnl)).over(line)).withColumn("peak", F.greatest(F.max("equity").over(line), F.lit(1.0)))
    df = df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
    return df.withColumn("max_drawdown", F.least(F.min("drawdown").over(line), F.lit(0.0)))


def feature_matrix(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted features as doubles, absent, null, NaN and infinite ones 0, in the order of training."""
    cell = lambda x: F.coalesce(F.when(~(F.isnan(c(x).try_cast("double")) | (F.abs(c(x).try_cast("double")) == float("inf"))), c(x).try_cast("double")), F.lit(0.0))
    return df.withColumns({x: cell(x) if x in df.columns else F.lit(0.0) for x in wanted})


def trade_metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg((F.col("pnl_pct") > 0).cast("double")).alias("hit_rate"), F.avg("pnl_pct").alias("expectancy"), F.avg(F.datediff("exit_date", "entry_date").cast("double")).alias("avg_hold_days"))


def prob_ranges(df: DataFrame, ranges: list[tuple[float, float]], p: str = "prob") -> DataFrame:
    """Rows within each range, inclusive, with its label; a row may be in several. The ranges are a parameter, a few rows."""
    table = df.sparkSession.createDataFrame([(float(a), float(b), f"{a:g}-{b:g}") for a, b in ranges], "_lo double, _hi double, range string")
    return df.join(F.broadcast(table), c(p).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def unit_repair(df: DataFrame, x: str) -> DataFrame:
    """A percent column divided by 100 if any of its values shows that it is in percent (over 1.5)."""
    top = df.agg((F.max(F.abs(c(x))) > 1.5).alias("_pct"))
    return df.join(F.broadcast(top), F.lit(True), "inner").withColumn(x, F.when(F.col("_pct"), c(x) / 100).otherwise(c(x))).drop("_pct")
