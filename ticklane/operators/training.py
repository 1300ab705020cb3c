"""A return model as an artefact: trained on trades, with its report and its fitted bins, and applied in a later run.

The artefact is a folder: the pipeline, its features in order, and one JSON row with metrics and the borders and statistics of the
predictions.  All of it is of a fixed size; reports are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.functions.base import c
from ticklane.functions.quantiles import exact_quantiles
from ticklane.operators import ml
from ticklane.operators.buckets import qcut
from ticklane.operators.metrics import assign_bins, calibrated_bins, quintile_report, regression_metrics
from ticklane.sources.scratch import written
from ticklane.sources.sinks import load_model, save_model, save_tables

BINS = 5


def fit_bins(df: DataFrame, x: str = "prediction", bins: int = BINS) -> dict:
    """cuts (at k/bins), mean, std, min, max and median of a prediction; without any value no cuts."""
    df = written(df.select(F.col(x).cast("double").alias("x")), "fitted")
    at = [k / bins for k in range(1, bins)]
    *cuts, middle = exact_quantiles(df, {"x": [*at, 0.5]})[None, "x"]
    stats = df.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")).first().asDict()
    return {"cuts": [v for v in cuts if v is not None], "median": middle, **stats}


def apply_bins(df: DataFrame, fitted: dict, x: str = "prediction", by: str = "date", tie: tuple[str, ...] = ("code",), bins: int = BINS, calibrate: bool = False) -> DataFrame:
    """df with predicted_bin_abs (the fitted borders; 0 without any, or without a prediction), predicted_bin_rel (the place among
    the rows of ``by``, ties by ``tie``; 0 without a prediction) and predicted_bin (the absolute one)."""
    cuts = fitted["cuts"]
    absolute = F.lit(0) if not cuts else calibrated_bins(x, cuts, fitted["mean"], fitted["std"]) if calibrate else assign_bins(x, cuts)
    has = F.col(x).isNotNull() & ~F.isnan(x)
    ranked = qcut(df.where(has), x, bins, by=[by], tie=list(tie), name="predicted_bin_rel")
    rest = df.where(~has).withColumn("predicted_bin_rel", F.lit(0).cast("long"))
    out = ranked.unionByName(rest).withColumn("predicted_bin_abs", F.when(has, absolute).otherwise(0).cast("long"))
    return out.withColumn("predicted_bin", F.col("predicted_bin_abs"))


def training_frame(trades: DataFrame, panel: DataFrame, day: str = "signal_date") -> DataFrame:
    """Trades (code, strategy, pnl_pct) with the panel's row of the day that they were decided on; those without either are left out."""
    keys = trades.where("pnl_pct IS NOT NULL").select("code", F.col(day).alias("date"), "strategy", "pnl_pct")
    return keys.join(panel, ["code", "date"])


def train_and_report(frame: DataFrame, features: list[str], path: str, target: str = "pnl_pct", by: str = "strategy", **how) -> dict[str, DataFrame]:
    """Train on a frame, save the artefact below path, and return the reports, which are saved there too: metrics, quintiles, quintiles_by.

    The report is in-sample, as a check of the fit; walk-forward runs judge the model.
    """
    frame = written(frame, "training")
    model = ml.train_regressor(frame, features, target, **how)
    scored = written(ml.predict(model, frame, features).select(F.col(target).alias("y"), F.col("prediction").alias("pred"), by, "code", "date"), "scored")
    fitted = fit_bins(scored, "pred")
    metrics = regression_metrics(scored).withColumns({"samples": F.lit(scored.count()), "features": F.lit(len(features))})
    reports = {"metrics": metrics, "quintiles": quintile_report(scored, tie=["code", "date"]), "quintiles_by": quintile_report(scored, tie=["code", "date"], by=[by])}
    row = metrics.first().asDict()
    save_model(model, path, features, {"metrics": row, "bins": fitted, "target": target})
    save_tables(reports, f"{path}/reports")
    return {n: frame.sparkSession.read.parquet(f"{path}/reports/{n}") for n in reports}


def score_candidates(spark: SparkSession, path: str, candidates: DataFrame, least: int = 5, calibrate: bool = False) -> DataFrame:
    """Candidates with prediction and bins of a saved artefact; as they are, with nulls and bins 0, where they have fewer than
    ``least`` of its features (absent features count as 0, as in training)."""
    model, features, report = load_model(spark, path)
    if sum(x in candidates.columns for x in features) < least:
        return candidates.withColumns({"prediction": F.lit(None).cast("double")} | {n: F.lit(0).cast("long") for n in ("predicted_bin_rel", "predicted_bin_abs", "predicted_bin")})
    return apply_bins(ml.predict(model, candidates, features), report["bins"], calibrate=calibrate)


def score_keys(spark: SparkSession, path: str, panel: DataFrame, keys: DataFrame) -> DataFrame:
    """Prediction and bins of each (code, date) of keys, by its panel row; a key without one is scored with zeros, as training fills gaps."""
    rows = keys.select("code", "date").distinct().join(panel, ["code", "date"], "left")
    return score_candidates(spark, path, rows, least=0).select("code", "date", "prediction", "predicted_bin_abs", "predicted_bin_rel", c("predicted_bin"))
