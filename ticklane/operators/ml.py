"""Models over panel features with pyspark.ml: return regressors, weighted classifiers, quantile models, scoring, random search."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane import config as cf
from ticklane.functions.quantiles import exact_quantiles
from ticklane.operators import backtest as bt
from ticklane.operators import labels
from ticklane.operators import signals as sg
from ticklane.operators.metrics import assign_bins, class_weights, feature_matrix, trade_metrics
from ticklane.sources.scratch import written


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")


def train_regressor(df: DataFrame, features: list[str], target: str, kind: str = "gbt", seed: int = 42, **how) -> PipelineModel:
    """Regress target on features (null, NaN and infinite features count as 0); rows without a target are left out."""
    made = GBTRegressor if kind == "gbt" else RandomForestRegressor
    defaults = {"maxIter": 20, "maxDepth": 4} if kind == "gbt" else {"numTrees": 40, "maxDepth": 6}
    model = made(featuresCol="_x", labelCol=target, predictionCol="prediction", seed=seed, **defaults | how)
    return Pipeline(stages=[_assembler(features), model]).fit(feature_matrix(df.where(F.col(target).isNotNull()), features))


def predict(model: PipelineModel, df: DataFrame, features: list[str], name: str = "prediction") -> DataFrame:
    """Rows with their prediction; features that are absent count as 0, as in training."""
    kept = df.columns
    keyed = feature_matrix(df.withColumns({f"_k_{x}": F.col(x) for x in features if x in kept}), features)
    out = model.transform(keyed).withColumnRenamed("prediction", name)
    return out.select(*[F.col(f"_k_{x}").alias(x) if x in features else F.col(x) for x in kept], name)


def train_classifier(df: DataFrame, features: list[str], label: str, kind: str = "gbt", balanced: bool = True, seed: int = 42, **how) -> PipelineModel:
    """A binary classifier: gbt, logistic (standardised) or mlp; classes weigh inversely to their size if balanced."""
    df = feature_matrix(df.where(F.col(label).isNotNull()), features).withColumn(label, F.col(label).cast("double"))
    stages: list = [_assembler(features)]
    if balanced and kind != "mlp":
        weights = class_weights(df, label).select(F.col("y").alias(label), F.col("weight").alias("_w"))  # a row a class
        df = df.join(F.broadcast(weights), label)
        how = {"weightCol": "_w"} | how
    if kind == "gbt":
        stages.append(GBTClassifier(featuresCol="_x", labelCol=label, seed=seed, **{"maxIter": 20, "maxDepth": 4} | how))
    else:
        stages.append(StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True))
        if kind == "logistic":
            stages.append(LogisticRegression(featuresCol="_z", labelCol=label, **{"maxIter": 50, "regParam": 1e-4} | how))
        else:
            layers = [len(features), 32, 16, 2]
            stages.append(MultilayerPerceptronClassifier(featuresCol="_z", labelCol=label, seed=seed, **{"layers": layers, "maxIter": 60} | how))
    return Pipeline(stages=stages).fit(df)


def score(model: PipelineModel, df: DataFrame, features: list[str], keys: list[str], name: str = "prob") -> DataFrame:
    """keys and the probability of class 1."""
    out = model.transform(feature_matrix(df, features))
    return out.select(*keys, vector_to_array("probability")[1].alias(name))


def train_quantile(df: DataFrame, features: list[str], target: str, q: float, bins: int = 5, **how) -> tuple[PipelineModel, list[float], list[float]]:
    """A quantile model: boosted trees for the mean and, in bins of the prediction, the q-quantile of what is left.

    A plain form to compare with; quantile_trees boosts the pinball loss itself.  Returns the model, bin borders and offsets.
    """
    model = train_regressor(df, features, target, **how)
    rest = predict(model, df.where(F.col(target).isNotNull()), features).withColumn("_e", F.col(target) - F.col("prediction"))
    rest = written(rest.select("prediction", "_e"), "residuals")
    cuts = sorted({x for x in exact_quantiles(rest, {"prediction": [k / bins for k in range(1, bins)]})[None, "prediction"] if x is not None})
    found = exact_quantiles(rest.withColumn("bin", assign_bins("prediction", cuts)), {"_e": [q]}, "bin")
    return model, cuts, [found.get((k, "_e"), [0.0])[0] for k in range(1, len(cuts) + 2)]


def predict_quantile(fitted: tuple[PipelineModel, list[float], list[float]], df: DataFrame, features: list[str], name: str) -> DataFrame:
    model, cuts, offsets = fitted
    out = predict(model, df, features)
    offset = F.element_at(F.array(*[F.lit(float(x)) for x in offsets]), assign_bins("prediction", cuts).cast("int"))
    return out.withColumn(name, F.col("prediction") + offset).drop("prediction")


def sample_configs(trials: int, seed: int = 7, base: cf.Config = cf.DEFAULT) -> list[cf.Config]:
    """Seeded random settings within the tuning ranges."""
    draw = random.Random(seed)
    out = []
    for _ in range(trials):
        out.append(base.merged({
            "s1": {"atr_mul": draw.uniform(1.4, 2.2), "atr_mul_pullback": draw.uniform(0.6, 1.2), "rsi_bull_low": float(draw.choice([40, 42, 45, 48, 50]))},
            "s2": {"bw_quantile": draw.uniform(0.15, 0.35), "atr_stop_mul": draw.uniform(0.8, 1.4)},
            "s3": {"rsi_buy": float(draw.choice([28, 30, 32, 35, 38, 40])), "atr_stop_mul": draw.uniform(1.0, 1.6)},
            "stock_state": {"adx_trend_th": float(draw.choice([22, 25, 28])), "adx_range_th": float(draw.choice([18, 20, 22]))},
        }))
    return out


#: What a trial sets: (group, name) of each setting.
TUNED = (
    ("s1", "atr_mul"), ("s1", "atr_mul_pullback"), ("s1", "rsi_bull_low"), ("s2", "bw_quantile"), ("s2", "atr_stop_mul"), ("s3", "rsi_buy"), ("s3", "atr_stop_mul"), ("stock_state", "adx_trend_th"),
    ("stock_state", "adx_range_th"))


def trial_ledgers(panel: DataFrame, state: DataFrame, configs: list[cf.Config], base: cf.Config = cf.DEFAULT, ways: tuple[cf.Config, ...] = ()) -> DataFrame:
    """Ledger trades of every trial, with its number: all trials in one pass.

    Indicators and windows don't depend on what is tuned, so they are made once (panel may have sg.add_windows() already).  A row meets
    every trial's settings, columns of a table of a row a trial, by arithmetic alone, and what travels of that are days on which a
    trial enters or raises a stop.  A code is folded in one task for all trials, and for all ways (see backtest.trial_trades()).
    """
    if not set(sg.WINDOWS) <= set(panel.columns):
        panel = sg.add_windows(panel, base)
    if "_rn" not in panel.columns:
        panel = panel.withColumn("_rn", F.row_number().over(W.partitionBy("code").orderBy("date")))
    tried, cfg = _tried(panel, state, configs, base)
    busy = bt.busy_days(tried.where("s1_entry = 1 OR s2_entry = 1 OR s3_long_entry = 1 OR s4_pyramid = 1"))
    return bt.trial_trades(panel, busy, cfg, ways) if ways else bt.trial_trades(panel, busy, cfg)


def _tried(panel: DataFrame, state: DataFrame, configs: list[cf.Config], base: cf.Config, none: bool = False) -> tuple[DataFrame, cf.Config]:
    """Every row with the signals of every trial, and the settings as columns. none: and of no trial, whose number is -1."""
    names = [f"_{g}_{n}" for g, n in TUNED]
    table = [(k, *(float(getattr(getattr(c, g), n)) for g, n in TUNED)) for k, c in enumerate(configs)]
    params = panel.sparkSession.createDataFrame(table + [(-1, *[None] * len(TUNED))] * none, "trial int, " + ", ".join(f"{n} double" for n in names))
    over: dict = {}
    for (g, n), column in zip(TUNED, names, strict=True):
        over.setdefault(g, {})[n] = F.col(column)
    cfg = base.merged(over)
    tried = sg.assemble(panel.join(F.broadcast(params), F.lit(True), "inner"), state, cfg)
    return tried.withColumn("technical_score", sg.technical_score()), cfg


def ledgers_in_one_pass(panel: DataFrame, state: DataFrame, configs: list[cf.Config], ways: tuple[cf.Config, ...], base: cf.Config = cf.DEFAULT) -> DataFrame:
    """trial_ledgers() of a panel that is dear to make or to keep: it is read once (it has sg.add_windows() and _rn); trades have no valuation."""
    tried, cfg = _tried(panel, state, configs, base, True)
    return bt.trial_trades_of_rows(tried, cfg, ways)


def _selection() -> Column:
    n = F.count("pnl_pct")
    return F.when(n == 0, F.lit(-1e9)).otherwise(F.avg((F.col("pnl_pct") > 0).cast("double")) * 100 + F.avg("pnl_pct") * 1000 + F.least(n.cast("double"), F.lit(20.0)) * 0.1)


def tune(trades: DataFrame, buckets: DataFrame, windows: DataFrame, trials: int) -> DataFrame:
    """The best trial of each window and bucket by the trades that enter in the window's validation span.

    trades: trial_ledgers(); buckets: code, bucket_id; windows: walk_windows().  Trials without trades score -1e9; of equal
    scores the first trial is taken.  Returns window_id, bucket_id, trial, trade_count, hit_rate, expectancy, selection_score.
    """
    spark = trades.sparkSession
    inside = labels.window_slices(trades.withColumn("date", F.col("entry_date")), windows, "val_start", "test_start").join(buckets, "code")
    grid = windows.select("window_id").crossJoin(F.broadcast(buckets.select("bucket_id").distinct())).crossJoin(F.broadcast(spark.range(trials).select(F.col("id").cast("int").alias("trial"))))  # some hundreds of rows
    found = grid.join(inside.select("window_id", "bucket_id", "trial", "pnl_pct"), ["window_id", "bucket_id", "trial"], "left").groupBy("window_id", "bucket_id", "trial").agg(
        F.count("pnl_pct").alias("trade_count"), F.avg((F.col("pnl_pct") > 0).cast("double")).alias("hit_rate"), F.avg("pnl_pct").alias("expectancy"), _selection().alias("selection_score"))
    line = W.partitionBy("window_id", "bucket_id").orderBy(F.round("selection_score", 9).desc(), "trial")
    return found.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")


def tuned_walk_forward(ledgers: dict[str, DataFrame], tuned: DataFrame, buckets: DataFrame, windows: DataFrame) -> DataFrame:
    """Metrics of each valuation variant in each window's test span, where every bucket trades its own tuned trial.

    ledgers: trial_ledgers() of each variant's settings; variants with the same frame are summed up once.
    """
    shared: dict[int, tuple[DataFrame, list[str]]] = {}
    for variant, trades in ledgers.items():
        shared.setdefault(id(trades), (trades, []))[1].append(variant)
    parts = []
    for trades, names in shared.values():
        inside = labels.window_slices(trades.withColumn("date", F.col("entry_date")), windows, "test_start", "test_end").join(buckets, "code")
        chosen = inside.join(tuned.select("window_id", "bucket_id", "trial"), ["window_id", "bucket_id", "trial"], "left_semi")
        found = windows.select("window_id", "test_start", "test_end").join(trade_metrics(chosen, ["window_id"]), "window_id", "left").fillna({"trade_count": 0})
        parts.append(found.withColumn("variant", F.explode(F.array(*[F.lit(n) for n in names]))))
    return reduce(DataFrame.unionByName, parts)


def walk_forward(trades: DataFrame, windows: DataFrame) -> DataFrame:
    """Metrics of the trades that enter in each window's test span; windows without trades are there with none."""
    inside = labels.window_slices(trades.withColumn("date", F.col("entry_date")), windows, "test_start", "test_end")
    return windows.select("window_id", "test_start", "test_end").join(trade_metrics(inside, ["window_id"]), "window_id", "left").fillna({"trade_count": 0})
