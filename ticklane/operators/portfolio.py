"""Top-N portfolio: ranking per day in Spark, holdings folded over days per variant and window, and what follows from them."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane import config as cf
from ticklane.functions.base import b, near, wd
from ticklane.operators import signals as sg
from ticklane.operators.labels import window_slices
from ticklane.sources.scratch import written

_EVENTS = (
    "kind string, code {code}, strategy string, side string, reason string, signal_date date, entry_signal_date date, entry_date date, entry_price double, exit_date date, exit_price double, "
    "pnl_pct double, days_held int, entry_score double, weight double, exit_score double, price double, score double, candidate_count long, top_n int, held_count int, target_exposure double, "
    "realized_exposure double, avg_top_score double, avg_held_score double, equity double, cash_weight double"
)
NAMES = [x.split(" ")[0] for x in _EVENTS.split(", ")]
TRADE = ["code", "strategy", "entry_signal_date", "entry_date", "entry_price", "exit_date", "exit_price", "pnl_pct", "days_held", "entry_score", "weight", "exit_score", "reason"]
ORDER = ["signal_date", "exit_date", "code", "side", "price", "weight", "score", "strategy", "reason"]
MONITOR = ["signal_date", "candidate_count", "top_n", "held_count", "target_exposure", "realized_exposure", "avg_top_score", "avg_held_score"]
EQUITY = ["exit_date", "equity", "held_count", "cash_weight"]
POSITION = ["code", "entry_date", "entry_price", "entry_score", "weight", "strategy", "days_held"]
def allocate(scores: list[float], exposure: float, p: cf.Portfolio) -> list[float]:
    """Weights of rows by score: as sg.add_weights has them for a day."""
    if not scores or exposure <= 0:
        return [0.0] * len(scores)
    raw = [max((p.min_score if math.isnan(s) else s) - p.min_score, 1.0) for s in scores]
    first = [min(max(r / sum(raw) * exposure, p.min_position_weight), p.max_position_weight) for r in raw]
    scale = exposure / max(sum(first), 1e-9)
    return [min(x * scale, p.max_position_weight) for x in first]


#: What a fold reads of a bar: numbers, and what is decided by the bar alone.
_NUMBERS = ["close", "atr_pct", "multifactor_score", "rank_today", "stop", "next_open", "place", "strategy_score"]
_FLAGS = ["signal", "breakdown", "under"]


def _trailing(pos: dict, close: float, atr: float, under: bool, p: cf.Portfolio) -> bool:
    profit, giveback = pos["peak"] / pos["price"] - 1, 1 - close / pos["peak"] if pos["peak"] > 0 else 0.0
    gave = not math.isnan(atr) and profit > 0 and giveback > max(p.trail_giveback_pct, p.trail_atr_buffer * atr)
    return profit >= p.trail_min_open_profit and (under or gave)


# The order in which reasons to sell are looked at, by exit style.
LADDERS = {
    "score": ("score_fade", "trail_exit", "signal_off", "rank_drop"),
    "trend": ("trend_break", "trail_exit", "score_fade", "signal_off", "rank_drop"),
    "rank": ("trail_exit", "rank_drop", "score_fade", "signal_off", "trend_break"),
}


def _exit(pos: dict, row: dict, on_top: bool, p: cf.Portfolio) -> str | None:
    """Why a holding ends on a day; the ladder's order depends on the exit style."""
    if row["close"] < row["stop"]:
        return "hit_stop"
    if pos["days"] >= p.max_hold_days:
        return "max_hold"
    if pos["days"] < p.min_hold_days:
        return None
    score, fade = row["multifactor_score"], max(p.floor, pos["score"] - p.exit_score_drop)
    rules = {
        "rank_drop": row["rank_today"] > p.top_n * p.exit_rank_mult + p.turnover_buffer and score < max(fade, pos["score"] - 0.5 * p.exit_score_drop),
        "score_fade": not on_top and score < fade,
        "signal_off": not on_top and not row["signal"] and score < p.signal_floor,
        "trend_break": not on_top and row["breakdown"],
        "trail_exit": _trailing(pos, row["close"], row["atr_pct"], row["under"], p),
    }
    return next((r for r in LADDERS[p.exit_style] if rules[r]), None)


def _fold(rows: pd.DataFrame, p: cf.Portfolio, cost: float) -> list[dict]:
    """Events of one variant over the days in order. rows: by date and code; only bars on top or held are looked at."""
    columns = {k: rows[k].to_numpy(float) for k in _NUMBERS} | {k: rows[k].to_numpy(object) for k in [*_FLAGS, "code", "strategy", "reason"]}
    dates = rows["date"].to_numpy(object)
    cuts = [0, *(i for i in range(1, len(dates)) if dates[i] != dates[i - 1]), len(dates)]
    days, after_, exposure, candidates = (rows[k].to_numpy(object) for k in ("date", "day_next", "day_exposure", "day_candidates"))

    def at(i: int) -> dict:
        return {k: v[i] for k, v in columns.items()}

    held: dict = {}
    equity, events = 1.0, []
    for low, high in list(itertools.pairwise(cuts))[:-1]:
        date, after, target = days[low], after_[low], float(exposure[low])
        if pd.isna(after):
            continue
        by_code = {c: low + i for i, c in enumerate(columns["code"][low:high]) if c is not None}
        place = columns["place"]
        top = sorted((i for i in by_code.values() if not math.isnan(place[i])), key=lambda i: place[i])  # noqa: B023
        top_codes = {columns["code"][i] for i in top}
        for code, pos in list(held.items()):
            if code not in by_code:
                continue
            row = at(by_code[code])
            pos["days"] += 1
            pos["peak"] = max(pos["peak"], row["close"])
            reason = _exit(pos, row, code in top_codes, p)
            price = row["next_open"]
            if not reason or math.isnan(price):
                continue
            pnl = (price - pos["price"]) / pos["price"] - cost
            equity *= 1 + pnl * pos["weight"]
            events.append({"kind": "trade", "code": code, "strategy": pos["strategy"], "entry_signal_date": pos["signal_date"], "entry_date": pos["date"], "entry_price": pos["price"], "exit_date": after, "exit_price": price, "pnl_pct": pnl, "days_held": pos["days"], "entry_score": pos["score"], "weight": pos["weight"], "exit_score": row["multifactor_score"], "reason": reason})
            events.append({"kind": "order", "signal_date": date, "exit_date": after, "code": code, "side": "SELL", "price": price, "weight": pos["weight"], "score": row["multifactor_score"], "strategy": pos["strategy"], "reason": reason})
            del held[code]
        room = max(0.0, target - sum(x["weight"] for x in held.values()))
        buys = [at(i) for i in top if columns["code"][i] not in held][: max(0, p.top_n - len(held))]
        for row, weight in zip(buys, allocate([r["strategy_score"] for r in buys], room, p), strict=True):
            price = row["next_open"]
            if math.isnan(price) or weight <= 0:
                continue
            held[row["code"]] = {"signal_date": date, "date": after, "price": price, "score": row["strategy_score"], "weight": weight, "strategy": row["strategy"], "peak": row["close"], "days": 0}
            events.append({"kind": "order", "signal_date": date, "exit_date": after, "code": row["code"], "side": "BUY", "price": price, "weight": weight, "score": row["strategy_score"], "strategy": row["strategy"], "reason": row["reason"]})
        invested = sum(x["weight"] for x in held.values())
        scores = [columns["strategy_score"][i] for i in top]
        events.append({"kind": "monitor", "signal_date": date, "candidate_count": int(candidates[low]), "top_n": p.top_n, "held_count": len(held), "target_exposure": target, "realized_exposure": invested, "avg_top_score": sum(scores) / len(scores) if scores else None, "avg_held_score": sum(x["score"] for x in held.values()) / len(held) if held else None})
        events.append({"kind": "equity", "exit_date": after, "equity": equity, "held_count": len(held), "cash_weight": max(0.0, 1 - invested)})
    events += [{"kind": "position", "code": k, "entry_date": x["date"], "entry_price": x["price"], "entry_score": x["score"], "weight": x["weight"], "strategy": x["strategy"], "days_held": x["days"]} for k, x in held.items()]
    return events


def _choices(variants: dict[str, cf.Portfolio]) -> dict[tuple, cf.Portfolio]:
    """Portfolios that pick a day's top rows in different ways; most variants share one."""
    return {(p.strategy_profile, p.min_score, p.top_n): p for p in variants.values()}


def ahead_columns() -> dict[str, Column]:
    """What simulations read of a code's rows by windows: next bar and place in the code's line.  For factor_panel's ``ahead``."""
    line = W.partitionBy("code").orderBy("date")
    return {"next_open": F.lead("open").over(line), "next_date": F.lead("date").over(line), "rn": F.row_number().over(line)}


def own_columns() -> dict[str, Column]:
    """What simulations read of a bar that its code's rows alone decide: ahead_columns() and bar_columns()."""
    return ahead_columns() | bar_columns()


def bar_columns() -> dict[str, Column]:
    """What they read of a bar itself: strategy, stop, flags and the rows that each profile trades.  For factor_panel's ``own``: made
    before rows are dealt to their days."""
    x = F.col
    return {
        "stop": sg.stop_for_row(), "strategy": sg.choose_strategy(),
        "signal": (x("s1_entry") + x("s2_entry") + x("s3_long_entry")) > 0, "under": b(x("close") < x("ema20")),
        "breakdown": b((x("close") < x("ema20")) & (x("ema20") < x("ema50"))) | b((x("close") < x("ema20")) & (x("dist_high20") < -0.12)) | b((x("ema20") < x("ema50")) & (x("adx14") < 16)),
    } | {f"fits_{p}": sg.profile_mask(p) for p in sg.MASKED if p != "value_trend"}


def day_columns() -> dict[str, Column]:
    """What they read that a day's codes decide, and the mask that reads it."""
    rank = F.row_number().over(wd().orderBy(near("multifactor_score").desc_nulls_last(), "code"))
    return {"rank_today": rank.cast("double"), "fits_value_trend": sg.profile_mask("value_trend")}


def prepared(factors: DataFrame) -> DataFrame:
    """factors with the columns of own_columns() and day_columns() that it lacks."""
    for made in (own_columns(), day_columns()):
        lacking = {k: e for k, e in made.items() if k not in factors.columns}
        factors = factors.withColumns(lacking) if lacking else factors
    return factors


#: Strategy scores are counted in steps of one over this, so that the last score on top of a day is known before rows are ranked.
_STEPS = 20


def tops(factors: DataFrame, variants: dict[str, cf.Portfolio]) -> tuple[DataFrame, DataFrame]:
    """Top rows of each choice and day (choice, date, code, rn, place, strategy_score, reason), and each day's figures
    (choice, date, day_candidates, mean_score, state).  factors: prepared().

    A first pass counts the eligible rows of each choice, day and step of score; the step in which the last place lies bounds
    what the second pass ranks: a few rows a day, however many codes there are.
    """
    choices = _choices(variants)
    df, switched = factors, [x for x in sg.SWITCHED if any(k[0] == x for k in choices)]
    if switched:
        df = df.join(F.broadcast(sg.switched_days(factors, switched)), "date")  # a row a day
    cells = []
    for k, (key, p) in enumerate(choices.items()):
        score, fits = sg.eligibility(p, F.col(f"switch_{key[0]}") if key[0] in sg.SWITCHED else None, made=True)
        cells.append(F.when(fits, F.struct(F.lit(k).alias("choice"), F.lit(p.top_n).alias("most"), score.alias("strategy_score"), F.coalesce(F.floor(score * _STEPS), F.lit(-1)).alias("step"))))
    every = df.select("date", "code", "rn", "candidate_score", "technical_score", "market_state_index", F.col("composite_reason").alias("reason"), F.explode(F.array_compact(F.array(*cells))).alias("_c")).select("*", "_c.*").drop("_c")
    counts = every.groupBy("choice", "date", "step").agg(F.count(F.lit(1)).alias("n"), F.first("most").alias("most"))
    down = W.partitionBy("choice", "date").orderBy(F.col("step").desc())
    counts = counts.withColumns({"_above": F.sum("n").over(down) - F.col("n"), "day_candidates": F.sum("n").over(W.partitionBy("choice", "date"))})
    least = counts.where(F.col("_above") < F.col("most")).groupBy("choice", "date").agg(F.min("step").alias("_least"), F.first("day_candidates").alias("day_candidates"))
    # least has a row a choice and day
    near_top = every.join(F.broadcast(least), ["choice", "date"]).where(F.col("step") >= F.col("_least"))
    top = near_top.withColumn("place", F.row_number().over(W.partitionBy("choice", "date").orderBy(*sg.eligible_order()))).where(F.col("place") <= F.col("most"))
    top = written(top.select("choice", "date", "code", "rn", F.col("place").cast("double").alias("place"), "strategy_score", "reason", "market_state_index", "day_candidates"), "tops")
    days = top.groupBy("choice", "date").agg(F.first("day_candidates").alias("day_candidates"), F.avg("strategy_score").alias("mean_score"), F.mode("market_state_index", deterministic=True).alias("state"))
    return top.drop("market_state_index", "day_candidates"), days


def ranked_days(factors: DataFrame, variants: dict[str, cf.Portfolio], windows: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The fold's rows for every variant and window: the bars from a day on top until a holding must have ended, with place,
    rank, stop and next open within the window, and the day's own figures.  Each day also has one row without a code.

    windows: window_id, start, end (end excluded); none: one window "all".  only: pairs (variant, window_id) to be simulated.
    What is broadcast is bounded by days and variants: the rows on top, their codes' places and the days' figures.
    """
    spark = factors.sparkSession
    factors = prepared(factors)
    choices = list(_choices(variants))
    settings = spark.createDataFrame(
        [(v, choices.index((p.strategy_profile, p.min_score, p.top_n)), p.max_hold_days, *map(float, (p.min_score, p.min_total_exposure, p.base_total_exposure, p.max_total_exposure))) for v, p in variants.items()],
        "variant string, choice int, longest int, least double, low double, base double, high double")
    top, figures = tops(factors, variants)
    x = F.col
    sliced = lambda df: df.withColumn("window_id", F.lit("all")) if windows is None else window_slices(df, windows.withColumn("_end", x("end")), "start", "end", ["_end"])
    inside = lambda what: what if windows is None else F.when(x("next_date") < x("_end"), what)  # noqa: E731  next bars count within the window
    days = sliced(factors.groupBy("date").agg(F.min("next_date").alias("next_date"))).select("window_id", "date", inside(x("next_date")).alias("day_next"))
    pairs = days.select("window_id").distinct().crossJoin(F.broadcast(settings))  # windows and variants: a few rows each
    if only is not None:
        pairs = pairs.join(only.select("variant", "window_id"), ["variant", "window_id"], "left_semi")
    figures = days.join(F.broadcast(pairs), "window_id").join(figures, ["choice", "date"], "left")
    target = sg.exposure(x("mean_score"), F.coalesce("state", F.lit("neutral")), x("least"), x("low"), x("base"), x("high"))
    figures = figures.select("variant", "window_id", "date", "day_next", F.coalesce("day_candidates", F.lit(0)).alias("day_candidates"), F.when(x("mean_score").isNull(), x("low")).otherwise(target).alias("day_exposure"))
    # a holding is bought on a day on top and ends after the longest time: a code's few days on top are one array
    placed = sliced(top).join(F.broadcast(pairs.select("variant", "window_id", "choice", "longest")), ["window_id", "choice"]).select("variant", "window_id", "date", "code", "rn", "longest", "place", "strategy_score", "reason")
    spans = placed.groupBy("variant", "window_id", "code").agg(F.collect_set("rn").alias("_on"), F.first("longest").alias("longest"))
    near_top = F.exists("_on", lambda t: (x("rn") >= t) & (x("rn") <= t + x("longest") + 1))
    rows = sliced(factors.select("code", "date", "rn", "close", "atr_pct", "multifactor_score", "rank_today", "stop", "strategy", *_FLAGS, "next_open", "next_date").join(F.broadcast(top.select("code").distinct()), "code", "left_semi"))
    rows = rows.withColumn("next_open", inside(x("next_open"))).drop("next_date", "_end")
    kept = rows.join(F.broadcast(spans), ["window_id", "code"]).where(near_top).drop("_on", "longest", "rn")
    kept = kept.join(F.broadcast(placed.drop("rn", "longest")), ["variant", "window_id", "date", "code"], "left").join(F.broadcast(figures), ["variant", "window_id", "date"])
    return kept.unionByName(figures, allowMissingColumns=True)


def simulate(factors: DataFrame, variants: dict[str, cf.Portfolio], cost_bp: float = 2.0, windows: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Events (see NAMES) of every variant in every window; each pair of them is folded in its own task."""
    kind = factors.schema["code"].dataType.simpleString()
    window = "string" if windows is None else windows.schema["window_id"].dataType.simpleString()

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        variant, own = pdf["variant"].iloc[0], pdf["window_id"].iloc[0]
        pdf = pdf.sort_values(["date", "code"], kind="stable")
        pdf["code"] = pdf["code"].astype(object).where(pdf["code"].notna(), None)
        found = pd.DataFrame(_fold(pdf, variants[variant], 2 * cost_bp / 1e4), columns=NAMES)
        for day in (x for x in NAMES if x.endswith("date")):  # a column without a date is no column of numbers
            found[day] = found[day].astype(object).where(found[day].notna(), None)
        found["variant"], found["window_id"] = pd.Series([variant] * len(found), dtype=object), own
        texts = {x: object for x in ("variant", "kind", "strategy", "side", "reason")}
        return found[["variant", "window_id", *NAMES]].astype(texts)

    rows = ranked_days(factors, variants, windows, only)
    return rows.groupBy("variant", "window_id").applyInPandas(folded, f"variant string, window_id {window}, " + _EVENTS.format(code=kind))


def of_kind(events: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    return events.where(F.col("kind") == kind).select("variant", "window_id", *columns)


def trades(events: DataFrame) -> DataFrame:
    return of_kind(events, "trade", TRADE).withColumnRenamed("reason", "exit_reason")


def orders(events: DataFrame) -> DataFrame:
    return of_kind(events, "order", ORDER).withColumnRenamed("exit_date", "execute_date")


def summary(trades_: DataFrame, by: tuple[str, ...] = ("variant",)) -> DataFrame:
    """metric, value rows of each variant."""
    found = trades_.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("trades"), F.avg((F.col("pnl_pct") > 0).cast("double")).alias("hit_rate"), F.avg("pnl_pct").alias("expectancy"),
        F.avg(F.col("days_held").cast("double")).alias("avg_hold_days"), F.avg("entry_score").alias("avg_entry_score"))
    return found.unpivot([*by], ["trades", "hit_rate", "expectancy", "avg_hold_days", "avg_entry_score"], "metric", "value")


def _metrics() -> list[Column]:
    n, hit = F.count("pnl_pct"), F.avg((F.col("pnl_pct") > 0).cast("double"))
    score = F.when(n == 0, F.lit(-1e9)).otherwise(hit * 100 + F.avg("pnl_pct") * 1000 + F.least(n.cast("double"), F.lit(300.0)) * 0.01)
    return [hit.alias("hit_rate"), F.avg("pnl_pct").alias("expectancy"), n.alias("trade_count"), F.avg(F.col("days_held").cast("double")).alias("avg_hold_days"), score.alias("score")]


def variant_metrics(trades_: DataFrame, windows: DataFrame | None, variants) -> DataFrame:
    """variant, window_id, hit_rate, expectancy, trade_count, avg_hold_days, score of every pair, also of those without a trade (score -1e9)."""
    spark = trades_.sparkSession
    names = spark.createDataFrame([(v, k) for k, v in enumerate(variants)], "variant string, variant_no int")
    pairs = (spark.createDataFrame([("all",)], "window_id string") if windows is None else windows.select("window_id")).crossJoin(F.broadcast(names))  # a few rows each
    return pairs.join(trades_.select("variant", "window_id", "pnl_pct", "days_held"), ["variant", "window_id"], "left").groupBy("variant", "window_id", "variant_no").agg(*_metrics())


def selection_score(trades_: DataFrame, cap: float = 300.0, bonus: float = 0.01) -> DataFrame:
    """Score by which a variant is picked: hits, expectancy and a capped bonus for many trades."""
    n = F.count(F.lit(1))
    return trades_.groupBy("variant").agg((F.avg((F.col("pnl_pct") > 0).cast("double")) * 100 + F.avg("pnl_pct") * 1000 + F.least(n.cast("double"), F.lit(cap)) * bonus).alias("selection_score"))


def best_of(metrics: DataFrame) -> DataFrame:
    """window_id, variant of each window's best score, rounded to 9 places; of equal ones the variant that is named first."""
    won = F.max_by("variant", F.struct(F.round("score", 9), -F.col("variant_no")))
    return metrics.groupBy("window_id").agg(won.alias("variant"))


def walk_forward(factors: DataFrame, windows: DataFrame, variants: dict[str, cf.Portfolio], cost_bp: float = 2.0) -> DataFrame:
    """For each window the variant that does best in its validation span, and how it does in its test span.

    windows: walk_windows().  All windows and variants are folded in one job a span.
    """
    val = windows.select("window_id", F.col("val_start").alias("start"), F.col("test_start").alias("end"))
    test = windows.select("window_id", F.col("test_start").alias("start"), F.col("test_end").alias("end"))
    picked = best_of(variant_metrics(trades(simulate(factors, variants, cost_bp, val)), val, variants))
    tested = variant_metrics(trades(simulate(factors, variants, cost_bp, test, picked)), test, variants)
    spans = windows.select("window_id", F.col("val_start"), F.col("test_start").alias("val_end"), "test_start", "test_end")
    return spans.join(picked, "window_id").join(tested.drop("variant_no", "score"), ["window_id", "variant"])


def add_baseline(walked: DataFrame, trades_: DataFrame) -> DataFrame:
    """Walk-forward rows with baseline_hit_rate, baseline_expectancy and baseline_trade_count of a ledger that has a window_id."""
    base = trades_.groupBy("window_id").agg(F.avg((F.col("pnl_pct") > 0).cast("double")).alias("baseline_hit_rate"), F.avg("pnl_pct").alias("baseline_expectancy"), F.count("pnl_pct").alias("baseline_trade_count"))
    return walked.join(base, "window_id", "left").fillna({"baseline_trade_count": 0})


def walk_forward_meta(factors: DataFrame, windows: DataFrame, variants: dict[str, cf.Portfolio] | None = None, cost_bp: float = 2.0) -> DataFrame:
    """Test metrics of every base variant in each window, and of the one that a vote of similar earlier windows picks (meta_model_selector)."""
    variants = variants or cf.VARIANT_SETS["combo_compare"]
    val = windows.select("window_id", F.col("val_start").alias("start"), F.col("test_start").alias("end"))
    test = windows.select("window_id", F.col("test_start").alias("start"), F.col("test_end").alias("end"))
    fallback = best_of(variant_metrics(trades(simulate(factors, variants, cost_bp, val)), val, variants)).withColumnRenamed("variant", "fallback")
    tested = variant_metrics(trades(simulate(factors, variants, cost_bp, test)), test, variants)
    label = tested.groupBy("window_id").agg(F.max_by("variant", F.struct(F.round("score", 9), -F.col("variant_no"))).alias("best_variant"), F.max("score").alias("label_score"))
    features = window_features(window_slices(factors, val, "start", "end"), ["window_id"])
    history = features.join(label, "window_id").join(fallback, "window_id").withColumnRenamed("window_id", "window")
    picks = meta_pick(history, [x for x in features.columns if x != "window_id"]).select(F.col("window").alias("window_id"), F.col("picked").alias("variant"))
    chosen = picks.join(tested, ["window_id", "variant"]).select("window_id", F.lit("meta_model_selector").alias("variant"), F.col("variant").alias("selected_variant"), *_KEPT)
    return tested.select("window_id", "variant", F.col("variant").alias("selected_variant"), *_KEPT).unionByName(chosen)


_KEPT = ["hit_rate", "expectancy", "trade_count", "avg_hold_days"]


def walk_summary(walked: DataFrame, by: str = "variant") -> DataFrame:
    """Means over windows by variant, best first."""
    numbers = [c for c in [*_KEPT, "baseline_hit_rate", "baseline_expectancy", "baseline_trade_count"] if c in walked.columns]
    return walked.groupBy(by).agg(*[F.avg(c).alias(c) for c in numbers]).orderBy(F.col("hit_rate").desc_nulls_last(), F.col("expectancy").desc_nulls_last(), by)


def net_actions(positions: DataFrame, candidates: DataFrame, last: DataFrame, top_n: int) -> DataFrame:
    """HOLD every position, BUY the best candidates not held into free slots.

    last: the as-of day's code, close; candidates: the top rows of the last signal day that can still be traded (code, place,
    target_weight, strategy, close, reason).  A position that is a candidate has the candidate's weight and strategy.
    """
    cand = candidates.select("code", F.col("target_weight").alias("_w"), F.col("strategy").alias("_s"))
    hold = positions.join(last, "code", "left").join(cand, "code", "left").select(
        "code", F.lit("HOLD").alias("action"), F.when(F.col("_s").isNotNull(), F.col("_w")).otherwise(F.col("weight")).alias("target_weight"), F.coalesce("_s", "strategy").alias("strategy"), "entry_date", "entry_price",
        F.col("close").alias("current_price"), F.when(F.col("entry_price") > 0, F.col("close") / F.col("entry_price") - 1).alias("pnl_pct"), F.lit("existing_position_hold").alias("reason"))
    free = positions.agg(F.greatest(F.lit(top_n) - F.count(F.lit(1)), F.lit(0)).alias("_free"))
    fresh = candidates.join(positions, "code", "left_anti").withColumn("_n", F.row_number().over(W.orderBy("place"))).join(F.broadcast(free), F.col("_n") <= F.col("_free"))  # one day's top rows
    buy = fresh.select(
        "code", F.lit("BUY").alias("action"), "target_weight", "strategy", F.lit(None).cast("date").alias("entry_date"), F.lit(None).cast("double").alias("entry_price"),
        F.col("close").alias("current_price"), F.lit(None).cast("double").alias("pnl_pct"), "reason")
    return hold.unionByName(buy).orderBy(F.when(F.col("action") == "HOLD", 1).otherwise(2), F.col("target_weight").desc_nulls_last(), "code")


def action_history(orders_: DataFrame, trades_: DataFrame, actions: DataFrame | None, as_of, start=None, end=None, recent_days: int = 10) -> DataFrame:
    """Orders from start (recent_days before as_of) to end (as_of), each SELL with its trade's result, and the HOLD rows of the
    as-of day's actions; the newest day first, on a day SELL, HOLD, BUY."""
    day = lambda x: F.lit(x).cast("date")
    since, until = day(start) if start else F.date_sub(day(as_of), recent_days), day(end if end else as_of)
    closed = trades_.groupBy("code", F.col("exit_date").alias("action_date")).agg(F.max_by("pnl_pct", "entry_date").alias("pnl_pct")).withColumn("action", F.lit("SELL"))
    done = orders_.select(F.col("execute_date").alias("action_date"), F.col("side").alias("action"), "code", F.col("weight").alias("target_weight"), "strategy", "reason").join(closed, ["code", "action_date", "action"], "left")
    if actions is not None:
        hold = actions.where("action = 'HOLD'").select(day(as_of).alias("action_date"), "action", "code", "target_weight", "strategy", "reason", "pnl_pct")
        done = done.unionByName(hold)
    place = F.when(F.col("action") == "SELL", 0).when(F.col("action") == "HOLD", 1).otherwise(2)
    done = done.select("action_date", "action", "code", "target_weight", "strategy", "reason", "pnl_pct")
    return done.where(F.col("action_date").between(since, until)).orderBy(F.col("action_date").desc(), place, "code")


def latest_candidates(factors: DataFrame, p: cf.Portfolio) -> DataFrame:
    """The top rows, with target weights, of the last day whose orders can be executed: the last but one of the panel."""
    days = factors.agg(F.max("date").alias("_last"))
    before = factors.join(F.broadcast(days), F.col("date") < F.col("_last")).agg(F.max("date").alias("_at"))
    rows = factors.join(F.broadcast(before), F.col("date") == F.col("_at")).drop("_at")
    top = sg.add_weights(sg.add_exposure(sg.top_of_day(rows, p), p), p)
    strategy = F.col("strategy") if "strategy" in top.columns else sg.choose_strategy().alias("strategy")
    return top.select("code", "place", "target_weight", strategy, "close", F.col("composite_reason").alias("reason"))


def daily_run(factors: DataFrame, lookback_months: int = 3, recent_days: int = 10, cost_bp: float = 2.0, cut=lambda df: df) -> dict[str, DataFrame]:
    """The daily report, 11 tables: regime of the last months, the profile it calls for, its portfolio (panel, trades, orders, monitor,
    equity, candidates, positions, summary), the day's actions and their history.  sinks.save_run() writes them all or none.

    The regime is one row that the driver reads to choose settings.  cut: writes and rereads a frame that several tables use.
    """
    last = factors.agg(F.max("date").alias("d")).first().d
    recent = factors.where(F.col("date") >= F.add_months(F.lit(last).cast("date"), -lookback_months))
    regime = window_features(recent.withColumn("as_of_date", F.lit(last).cast("date")), ["as_of_date"]).withColumn("regime", regime_label())
    regime = cut(regime.withColumn("profile", profile_of_regime(F.col("regime"))))
    p = cf.DAILY[regime.first().profile]
    events = cut(simulate(factors, {p.strategy_profile: p}, cost_bp))
    held = of_kind(events, "position", POSITION).drop("variant", "window_id")
    closes = factors.where(F.col("date") == F.lit(last).cast("date")).select("code", "close")
    candidates = cut(latest_candidates(factors, p))
    actions = net_actions(held, candidates, closes, p.top_n)
    history = action_history(orders(events), trades(events), actions, last, recent_days=recent_days)
    return {
        "regime": regime, "actions": actions, "history": history, "panel": factors, "trades": trades(events), "monitor": of_kind(events, "monitor", MONITOR), "equity": of_kind(events, "equity", EQUITY),
        "orders": orders(events), "candidates": candidates, "positions": held, "summary": summary(trades(events))}


# ---- regimes and variants --------------------------------------------------------------------------------------------


def window_features(factors: DataFrame, by: list[str]) -> DataFrame:
    """A window's features: daily modal state, medians and means, then the states' shares and medians and means over days."""
    middle = {"rsi": "rsi14", "rvol": "rvol20", "adx": "adx14", "atr": "atr_pct", "roc": "roc20"}
    day = factors.groupBy(*by, "date").agg(
        F.coalesce(F.mode("market_state_index", deterministic=True), F.lit("neutral")).alias("state"), *[F.median(x).alias(k) for k, x in middle.items()], F.avg("quality_score").alias("quality"), F.avg("signal_score").alias("signal"))
    share = lambda s: F.avg((F.col("state") == s).cast("double"))
    return day.groupBy(*by).agg(
        share("trend_ok").alias("trend_share"), share("range_bias").alias("range_share"), share("neutral").alias("neutral_share"), *[F.median(k).alias(k) for k in middle], F.avg("quality").alias("quality"), F.avg("signal").alias("signal"))


def regime_label():
    t, r = F.col("trend_share"), F.col("rsi")
    return (
        F.when((t >= 0.45) & (r >= 56) & (F.col("quality") >= 55), "quality_trend_regime").when((t >= 0.30) & (r >= 49) & (r <= 58) & (F.col("rvol") <= 1.20), "pullback_regime")
        .when((t >= 0.20) & (r >= 52) & (F.col("rvol") >= 0.95) & (F.col("signal") >= 50), "combo_regime").when((F.col("range_share") >= 0.25) | (r < 48), "weak_range_regime")
        .otherwise("mixed_transition"))


def profile_of_regime(label):
    return F.when(label == "weak_range_regime", "pullback_quality_combo").when(label == "quality_trend_regime", "quality_trend").otherwise("pullback")


def regime_variants(factors: DataFrame, windows: DataFrame, variants: dict[str, cf.Portfolio] | None = None, cost_bp: float = 2.0) -> DataFrame:
    """Test metrics of each base variant in each window, under the regime and the features of the window's validation span."""
    variants = variants or cf.VARIANT_SETS["combo_compare"]
    val = windows.select("window_id", F.col("val_start").alias("start"), F.col("test_start").alias("end"))
    test = windows.select("window_id", F.col("test_start").alias("start"), F.col("test_end").alias("end"))
    found = variant_metrics(trades(simulate(factors, variants, cost_bp, test)), test, variants)
    features = window_features(window_slices(factors, val, "start", "end"), ["window_id"]).withColumn("regime", regime_label())
    return windows.select("window_id", "val_start", F.col("test_start").alias("val_end"), "test_start", "test_end").join(features, "window_id").join(found, "window_id")


def regime_stability(metrics: DataFrame) -> DataFrame:
    """Mean metrics of each (regime, variant) and in how many windows the variant was best (of equal scores the first one).

    metrics: regime, window_id, variant, variant_no, hit_rate, expectancy, trade_count, avg_hold_days, score.
    """
    means = metrics.groupBy("regime", "variant").agg(*[F.avg(x).alias(x) for x in ("hit_rate", "expectancy", "trade_count", "avg_hold_days", "score")])
    best = best_of(metrics).join(metrics.select("window_id", "variant", "regime"), ["window_id", "variant"])
    wins = best.groupBy("regime", "variant").agg(F.count(F.lit(1)).alias("win_count"))
    return means.join(wins, ["regime", "variant"], "left").fillna({"win_count": 0})


def regime_summary(metrics: DataFrame) -> DataFrame:
    """regime_stability by regime, the variants that won most often first."""
    return regime_stability(metrics).orderBy("regime", F.col("win_count").desc(), F.col("expectancy").desc_nulls_last(), "variant")


def meta_pick(history: DataFrame, features: list[str], k: int = 5, least: int = 6) -> DataFrame:
    """For each window, the variant that the k nearest earlier windows vote for, or its fallback with fewer than ``least`` earlier ones.

    history: window (in order), best_variant, label_score, fallback and the features.  Features are scaled by the median and
    the quartile range of the earlier windows; a missing one of an earlier window counts as the median.  Votes weigh 1 / max(distance,
    0.05); of equal distances the higher label_score goes first; of equal votes the variant voted for first.  The
    table is joined with itself on earlier windows, of which there are a few dozen.
    """
    past = history.select(*[F.col(x).alias(f"p_{x}") for x in ["window", "best_variant", "label_score", *features]])
    pairs = history.join(past, F.col("p_window") < F.col("window"))
    mine = W.partitionBy("window")
    scaled = []
    for f in features:
        middle, spread = F.median(f"p_{f}").over(mine), F.percentile(f"p_{f}", 0.75).over(mine) - F.percentile(f"p_{f}", 0.25).over(mine)
        unit = F.when(spread > 0, spread).otherwise(1.0)
        scaled.append(F.pow(F.coalesce((F.col(f"p_{f}") - middle) / unit, F.lit(0.0)) - F.coalesce((F.col(f) - middle) / unit, F.lit(0.0)), 2))
    pairs = pairs.withColumns({"_d": F.round(F.sqrt(sum(scaled)), 9), "_past": F.count(F.lit(1)).over(mine)})
    line = mine.orderBy("_d", F.col("p_label_score").desc_nulls_last(), "p_window")
    near_ = pairs.withColumn("_n", F.row_number().over(line)).where((F.col("_n") <= k) & (F.col("_past") >= least))
    votes = near_.groupBy("window", "p_best_variant").agg(F.sum(1 / F.greatest("_d", F.lit(0.05))).alias("v"), F.min("_n").alias("_first"))
    won = votes.groupBy("window").agg(F.max_by("p_best_variant", F.struct(F.round("v", 9), -F.col("_first"))).alias("_won"))
    return history.select("window", "fallback").join(won, "window", "left").select("window", F.coalesce("_won", "fallback").alias("picked"))
