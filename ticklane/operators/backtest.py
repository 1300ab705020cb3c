"""Path-dependent trade simulations: one position per code, independent virtual trades, a risk-budget portfolio, live orders."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticklane import config as cf
from ticklane.operators import signals as sg

#: What the folds read of a signal panel, besides code and date.
READ = (
    "open", "close", "ema20", "ema50", "boll_mid", "macd_dif", "macd_dea", "psar", "market_state_index", "market_state_stock", "s1_entry", "s1_stop", "s1_pos", "s2_entry", "s2_stop",
    "s2_pos", "s3_long_entry", "s3_stop", "s3_pos", "s4_pyramid", "technical_score", "value_score", "pb_cs_rank", "ps_cs_rank",
)

#: Valuation of the signal's day: trades carry it, and null where the signals lack it; see with_values().
VALUES = ("value_score", "pb_cs_rank", "ps_cs_rank")

_TRADE = (
    "code {code}, strategy string, signal_date date, entry_date date, entry_price double, exit_date date, exit_price double, pnl_pct double, entry_pos double, exit_reason string, "
    "initial_stop double, stop_on_exit double, confidence int, value_score double, pb_cs_rank double, ps_cs_rank double"
)


def _columns(rows: pd.DataFrame) -> dict[str, list]:
    return {k: rows[k].tolist() for k in rows.columns}


def _exit_reason(col: dict, i: int, strategy: str, stop: float) -> str | None:
    """Why a position ends on the close of day i. Comparisons with a missing value are false."""
    close = col["close"][i]
    if close < stop:
        return "hit_stop"
    if strategy == "S1":
        crossed = i > 0 and col["macd_dif"][i] < col["macd_dea"][i] and col["macd_dif"][i - 1] >= col["macd_dea"][i - 1]
        return "ema50_break or macd_dead" if close < col["ema50"][i] or crossed else None
    if strategy == "S2":
        return "midband_fail" if close < col["boll_mid"][i] else None
    return "mean_revert_tp" if close >= col["boll_mid"][i] else None


def _open_gate(col: dict, i: int) -> bool:
    return bool(col["_value_ok"][i]) and (col["market_state_index"][i] in ("trend_ok", "neutral") or col["market_state_stock"][i] == "range")


def _hits(col: dict, i: int) -> list[str]:
    """Strategies that a day enters, best first."""
    stock = col["market_state_stock"][i]
    found = ["S2"] if col["s2_entry"][i] == 1 else []
    if col["s1_entry"][i] == 1 and stock == "trend":
        found.append("S1")
    if col["s3_long_entry"][i] == 1 and stock == "range":
        found.append("S3")
    return found


def _raised(stop: float, col: dict, i: int) -> float:
    """The stop after a pyramid day: the highest of those that are there."""
    return max([x for x in (stop, col["psar"][i], col["ema20"][i]) if not math.isnan(x)], default=math.nan)


def _trade(col: dict, i: int, strategy: str, entry_date, entry_price: float, exit_date, exit_price: float, reason: str, first_stop: float, stop: float, cost: float) -> tuple:
    return (
        col["code"][i], strategy, col["date"][i], entry_date, entry_price, exit_date, exit_price, (exit_price - entry_price) / entry_price - cost, col[f"{strategy.lower()}_pos"][i], reason,
        first_stop, stop, int(col["technical_score"][i]), col["value_score"][i], col["pb_cs_rank"][i], col["ps_cs_rank"][i])


def _ledger(col: dict, cost: float) -> list[tuple]:
    """Fold of one position over a code's days."""
    n, trades, held = len(col["date"]), [], None
    for i in range(n - 1):
        if held:
            reason = _exit_reason(col, i, held["strategy"], held["stop"])
            if reason:
                trades.append(_trade(col, held["i"], held["strategy"], col["date"][held["i"]], held["price"], col["date"][i + 1], col["open"][i + 1], reason, held["first"], held["stop"], cost))
                held = None
        if held is None and _open_gate(col, i) and (hits := _hits(col, i)):
            stop = col[f"{hits[0].lower()}_stop"][i]
            held = {"strategy": hits[0], "i": i, "price": col["open"][i + 1], "first": stop, "stop": stop}
        if held and held["strategy"] != "S3" and col["s4_pyramid"][i] == 1 and not math.isnan(held["stop"]):
            held["stop"] = _raised(held["stop"], col, i)
    if held:
        trades.append(_trade(col, held["i"], held["strategy"], col["date"][held["i"]], held["price"], col["date"][n - 1], col["close"][n - 1], "eod_close", held["first"], held["stop"], cost))
    return trades


def _virtual(col: dict, cost: float) -> list[tuple]:
    """A trade of its own for every entry, strategies apart."""
    n, trades = len(col["date"]), []
    for i in range(n - 1):
        if not _open_gate(col, i):
            continue
        for strategy in _hits(col, i):
            first = stop = col[f"{strategy.lower()}_stop"][i]
            reason, at, price, left = "eod_close", n - 1, col["close"][n - 1], None
            for j in range(i, n - 1):
                found = _exit_reason(col, j, strategy, stop)
                if found:
                    reason, at, price, left = found, j + 1, col["open"][j + 1], stop if found == "hit_stop" else math.nan
                    break
                if strategy != "S3" and col["s4_pyramid"][j] == 1:
                    stop = _raised(stop, col, j)
            trades.append(_trade(col, i, strategy, col["date"][i + 1], col["open"][i + 1], col["date"][at], price, reason, first, stop if left is None else left, cost))
    return trades


def _per_code(signals: DataFrame, cfg: cf.Config, fold) -> DataFrame:
    cost = 2 * cfg.cost_bp / 1e4
    names = [x.split(" ")[0] for x in _TRADE.split(", ")]
    kinds = {f.name: f.dataType for f in signals.schema.fields}
    df = signals.withColumns({"technical_score": sg.technical_score(), "_value_ok": sg.value_allowed(cfg)})
    cell = lambda x: F.col(x) if isinstance(kinds.get(x), T.StringType) else (F.lit(None) if x in VALUES and x not in kinds else F.col(x)).cast("double").alias(x)
    df = df.select("code", "date", *[cell(x) for x in READ], "_value_ok")

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(_columns(rows.sort_values("date", kind="stable")), cost), columns=names)

    return df.groupBy("code").applyInPandas(folded, _TRADE.format(code=kinds["code"].simpleString()))


#: What a trial's settings decide of a bar.
TRIED = ("market_state_stock", "s1_entry", "s1_stop", "s1_pos", "s2_entry", "s2_stop", "s2_pos", "s3_long_entry", "s3_stop", "s3_pos", "s4_pyramid", "technical_score")
#: Bits of a bar that no trial changes: under the long mean, under or not under the middle band, the fast line under or not under the slow one.
_UNDER_LONG, _UNDER_MIDDLE, _OVER_MIDDLE, _FAST_UNDER, _FAST_OVER, _WAYS = 1, 2, 4, 8, 16, 5


def busy_days(tried: DataFrame) -> DataFrame:
    """code, _rn, trial of the days on which a trial may enter (entry: 1 to 3, with stop, pos and confidence) or raises a stop (to raised).

    tried: rows with a trial's columns TRIED, psar, ema20 and the market's state; what only folds would tell apart is left to them.
    """
    return _busy(tried, F.lit(False)).select("code", "_rn", "trial", *_BUSY)


_BUSY = ("entry", "stop", "pos", "confidence", "raised")


def _busy(tried: DataFrame, also: Column) -> DataFrame:
    """The busy rows of tried, and those of also, with the columns _BUSY."""
    stock = F.col("market_state_stock")
    gate = F.coalesce(F.col("market_state_index").isin("trend_ok", "neutral"), F.lit(False)) | F.coalesce(stock == "range", F.lit(False))
    entry = F.when(F.col("s2_entry") == 1, 2).when((F.col("s1_entry") == 1) & (stock == "trend"), 1).when((F.col("s3_long_entry") == 1) & (stock == "range"), 3)
    raised = F.when(F.col("s4_pyramid") == 1, F.greatest(F.col("psar").cast("double"), F.col("ema20").cast("double")))
    of = lambda x: F.when(F.col("entry") == 2, F.col(f"s2_{x}")).when(F.col("entry") == 1, F.col(f"s1_{x}")).when(F.col("entry") == 3, F.col(f"s3_{x}")).cast("double")
    found = tried.withColumns({"entry": F.when(gate, entry), "raised": raised}).where(also | F.col("entry").isNotNull() | F.col("raised").isNotNull())
    return found.withColumns({"stop": of("stop"), "pos": of("pos"), "confidence": F.when(F.col("entry").isNotNull(), F.col("technical_score").cast("int"))})


def _next(hit: np.ndarray) -> list[int]:
    """The first day from each on that hits; the number of days where there is none."""
    there = np.append(np.flatnonzero(hit), len(hit))
    return there[np.searchsorted(there, np.arange(len(hit) + 1))].tolist()


def _trial_ledger(days: dict, ok: list[bool], busy: list[tuple], cost: float) -> list[tuple]:
    """_ledger() of one trial: (strategy, day of entry, price, day of exit, price, reason, first stop, last stop, pos, confidence); the days between entries are passed over."""
    opened, close, rule, crossing = days["open"], days["close"], days["rule"], days["reason"]
    n, free, trades = len(close), 0, []
    raises = {at: x for at, _, _, _, _, x in busy if x == x}
    for i, entry, first, pos, confidence, _ in busy:
        if not entry or i < free or i >= n - 1 or not ok[i]:
            continue
        stop, out, last = first, None, min(rule[entry][i + 1], n - 1)
        lifts = entry != 3 and stop == stop
        if lifts and i in raises:
            stop = max(stop, raises[i])
        for j in range(i + 1, last):
            if close[j] < stop:
                out = "hit_stop"
                break
            if lifts and j in raises:
                stop = max(stop, raises[j])
        else:
            j = last
            if j < n - 1:
                out = "hit_stop" if close[j] < stop else crossing[entry]
        if out:
            trades.append((f"S{entry}", i, opened[i + 1], j + 1, opened[j + 1], out, first, stop, pos, confidence))
            free = j
        else:
            trades.append((f"S{entry}", i, opened[i + 1], n - 1, close[n - 1], "eod_close", first, stop, pos, confidence))
            break
    return trades


def trial_trades(bars: DataFrame, busy: DataFrame, cfg: cf.Config = cf.DEFAULT, ways: tuple[cf.Config, ...] = ()) -> DataFrame:
    """backtest_ledger() of many trials, with the trial's number: each code's bars reach its task once, for all trials.

    bars: code, date, _rn (the row's number in its code) and what READ has besides TRIED; what trades hand on of VALUES may lack and is null then.
    busy: busy_days().  ways: settings whose ways to allow a row at its valuation are each folded, with the way's place in ``way``.
    """
    code, values = bars.schema["code"].dataType, [x for x in VALUES if x in bars.columns]
    bars = bars.select("code", "date", "_rn", *[F.col(x).cast("double").alias(x) for x in ("open", "close", *values)], _flags(ways or (cfg,)).alias("_flags"))
    busy = busy.withColumnsRenamed({"code": "_code", "_rn": "_at"})
    folded, schema = _trial_fold(cfg, ways, values, code)
    return bars.groupBy("code").cogroup(busy.groupBy("_code")).applyInArrow(folded, schema)


def trial_trades_of_rows(tried: DataFrame, cfg: cf.Config = cf.DEFAULT, ways: tuple[cf.Config, ...] = ()) -> DataFrame:
    """trial_trades() of rows that met every trial and, as trial -1, none: bars and busy days go to their code as rows of one exchange, so
    the panel behind them is made once and written nowhere."""
    code, own = tried.schema["code"].dataType, F.col("trial") == -1
    bar = {"date": F.col("date"), "open": F.col("open").cast("double"), "close": F.col("close").cast("double"), "_flags": _flags(ways or (cfg,))}
    rows = _busy(tried, own).withColumns({x: F.when(own, made) for x, made in bar.items()}).select("code", "_rn", "trial", *_BUSY, *bar)
    fold, schema = _trial_fold(cfg, ways, [], code)

    def folded(rows: pa.Table) -> pa.Table:
        own = pc.equal(rows["trial"], -1)
        return fold(rows.filter(own), rows.filter(pc.invert(own)).rename_columns([{"_rn": "_at"}.get(x, x) for x in rows.column_names]))

    return rows.groupBy("code").applyInArrow(folded, schema)


def _flags(ways: tuple[cf.Config, ...]) -> Column:
    """What no trial changes of a bar, as bits; a null counts as false."""
    bit = lambda p, x: F.when(p, x).otherwise(0)
    close, middle, fast, slow = (F.col(x).cast("double") for x in ("close", "boll_mid", "macd_dif", "macd_dea"))
    flags = bit(close < F.col("ema50"), _UNDER_LONG) + bit(close < middle, _UNDER_MIDDLE) + bit(close >= middle, _OVER_MIDDLE) + bit(fast < slow, _FAST_UNDER) + bit(fast >= slow, _FAST_OVER)
    for k, way in enumerate(ways):
        flags = flags + bit(sg.value_allowed(way), 1 << (_WAYS + k))
    return flags.cast("int")


def _trial_fold(cfg: cf.Config, ways: tuple[cf.Config, ...], values: list[str], code: T.DataType):
    """The fold of a code's bars and of its busy days of all trials, and the schema of what it gives."""
    cost, many = 2 * cfg.cost_bp / 1e4, len(ways) or 1
    schema = ("way int, " if ways else "") + "trial int, " + _TRADE.format(code=code.simpleString())
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def folded(rows: pa.Table, days: pa.Table) -> pa.Table:
        rows, days = rows.sort_by("_rn"), days.sort_by([("trial", "ascending"), ("_at", "ascending")])
        bits = rows["_flags"].to_numpy()
        under, over = bits & _FAST_UNDER > 0, bits & _FAST_OVER > 0
        crossed = np.append(False, under[1:] & over[:-1])[: len(bits)]
        shared = {x: rows[x].to_numpy().tolist() for x in ("open", "close")}
        shared["rule"] = {1: _next((bits & _UNDER_LONG > 0) | crossed), 2: _next(bits & _UNDER_MIDDLE > 0), 3: _next(bits & _OVER_MIDDLE > 0)}
        shared["reason"] = {1: "ema50_break or macd_dead", 2: "midband_fail", 3: "mean_revert_tp"}
        trial, at = days["trial"].to_numpy(), days["_at"].to_numpy() - 1
        ends = np.flatnonzero(np.diff(trial, append=-1, prepend=-1)) if len(trial) else np.zeros(0, int)
        every = list(zip(at.tolist(), days["entry"].fill_null(0).to_pylist(), *(days[x].to_numpy().tolist() for x in ("stop", "pos")), days["confidence"].fill_null(0).to_pylist(), days["raised"].to_numpy().tolist(), strict=True))
        found = []
        for k in range(many):
            ok = (bits & (1 << (_WAYS + k)) > 0).tolist()
            for a, b in itertools.pairwise(ends.tolist()):
                found += [((k,) if ways else ()) + (int(trial[a]), *x) for x in _trial_ledger(shared, ok, every[a:b], cost)]
        if not found:
            return kinds.empty_table()
        *first, strategy, i, price, j, left, reason, stop, last, pos, confidence = (list(x) for x in zip(*found, strict=True))
        i, j = pa.array(i), pa.array(j)
        pnl = [(y - x) / x - cost for x, y in zip(price, left, strict=True)]
        made = [*first, rows["code"].take(i), strategy, rows["date"].take(i), rows["date"].take(i), price, rows["date"].take(j), left, pnl, pos, reason, stop, last, confidence]
        made += [rows[x].take(i) if x in values else [None] * len(i) for x in VALUES]
        cell = lambda x, kind: x.combine_chunks().cast(kind) if isinstance(x, pa.ChunkedArray) else x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind, from_pandas=True)
        return pa.table([cell(x, f.type) for x, f in zip(made, kinds, strict=True)], schema=kinds)

    return folded, schema


def with_values(trades: DataFrame, valued: DataFrame) -> DataFrame:
    """Trades with the valuation of their signal's day (valued: code, date and VALUES).

    Where settings do not filter entries by it, trades of signals without valuation ranks and this join spare the signals' way
    to their days and back to their codes.
    """
    return trades.drop(*VALUES).join(valued.select("code", F.col("date").alias("signal_date"), *VALUES), ["code", "signal_date"], "left")


def backtest_ledger(signals: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """Trades of one position per code: enter at the next open on S2, S1 or S3, leave at the next open on stop or rule, at the last close else.

    entry_date is the signal's day; a day that leaves a position may enter one.  Codes are folded in their own tasks.
    """
    return _per_code(signals, cfg, _ledger)


def virtual_trades(signals: DataFrame, cfg: cf.Config = cf.DEFAULT) -> DataFrame:
    """Trades as if every entry signal were taken alone; exits are looked for from the signal's day on."""
    return _per_code(signals, cfg, _virtual)


def strategy_summary(trades: DataFrame) -> DataFrame:
    pnl = F.col("pnl_pct")
    return trades.groupBy("strategy").agg(
        F.count("pnl_pct").alias("trades"), F.avg((pnl > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(pnl <= 0, pnl)), F.lit(0.0)).alias("avg_loss"), F.avg(pnl).alias("expectancy"))


# ---- risk-budget portfolio -------------------------------------------------------------------------------------------

HARD_STOP, CONFIRM_DAYS, RISK_BUDGET = -0.08, 2, 0.12


def add_risk(preds: DataFrame) -> DataFrame:
    """risk and score of predictions (pred_ret, pred_mae)."""
    return preds.withColumn("risk", F.abs("pred_mae")).withColumn("score", F.col("pred_ret") / (F.col("risk") + 1e-6))


def candidate_pool(preds: DataFrame, hard_stop: float = HARD_STOP) -> DataFrame:
    return preds.where((F.col("pred_mae") >= hard_stop) & (F.col("pred_ret") > 0) & F.col("score").isNotNull() & ~F.isnan("score"))


def top_prefix(pool: DataFrame, budget: float = RISK_BUDGET) -> DataFrame:
    """Each day's best candidates until their risks fill the budget; rows without risk are passed over.  Adds place.

    A running sum over positive risks only grows, so the first overflow is where the prefix ends.
    """
    line = W.partitionBy("date").orderBy(F.col("score").desc(), "code")
    pool = pool.where(F.col("risk") > 0).withColumn("_sum", F.sum("risk").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return pool.where(F.col("_sum") <= budget + 1e-15).withColumn("place", F.row_number().over(line)).drop("_sum")


def risk_parity(rows: DataFrame) -> DataFrame:
    """weight of each row of a day, in inverse proportion to risk."""
    inverse = 1.0 / F.greatest("risk", F.lit(1e-6))
    return rows.withColumn("_i", inverse).withColumn("weight", F.col("_i") / (F.sum("_i").over(W.partitionBy("date")) + 1e-12)).drop("_i")


def _holdable(rows: DataFrame, by: str) -> DataFrame:
    """Rows (by, code, _k the day's number, place) of the days on which a code can be held or is priced, without _k.

    Of the days after a code was on top last, one at least of every two counts as out (a day on its stop without a bar after it is
    followed by one), and CONFIRM_DAYS send it off: a few days, and the first bar after them where there was none.
    """
    line, reach = W.partitionBy(by, "code").orderBy("_k"), 2 * CONFIRM_DAYS + 1
    rows = rows.withColumns({"_top": F.last(F.when(F.col("place").isNotNull(), F.col("_k")), True).over(line.rowsBetween(W.unboundedPreceding, 0)), "_bar": F.lag("_k").over(line)})
    return rows.where((F.col("_k") <= F.col("_top") + reach) | (F.col("_bar") < F.col("_top") + reach)).drop("_k", "_top", "_bar")


_RISK = "date_open date, next_date_open date, ret double, equity double, drawdown double, max_drawdown double, n_positions int, buys int, sells int"


def risk_budget_sim(preds: DataFrame, budget: float = RISK_BUDGET, by: str = "variant") -> DataFrame:
    """Daily equity of the portfolio that holds each day's top prefix: hard stop, leave after CONFIRM_DAYS outside, fill up to the cap.

    preds: date, code, open, pred_ret, pred_mae and the variant that is simulated.  Ranking and prefixes are made per day
    by Spark; what is folded, in one task a variant, is days in order, each with the few rows that are on top or that held
    ones may need (a few days after a code was on top, not all the days of codes that ever were): rows of a variant reach its task as (date, code, open, stopped, place, risk).
    """
    preds = add_risk(preds)
    top = top_prefix(candidate_pool(preds), budget).select(by, "date", "code", "place")
    rows = preds.join(top, [by, "date", "code"], "left").select(by, "date", "code", "open", "place", "risk", (F.col("pred_mae") < HARD_STOP).alias("stopped"))
    # numbers of days: a row a variant and date, which the calendar bounds
    days = preds.select(by, "date").distinct().withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy("date")))
    rows = _holdable(rows.join(F.broadcast(days), [by, "date"]), by)
    rows = days.select(by, "date").join(rows, [by, "date"], "left")  # days without such a code are days
    kind = rows.schema[by].dataType.simpleString()

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        days = {d: g[g["code"].notna()].set_index("code") for d, g in pdf.sort_values(["date", "code"]).groupby("date", sort=True)}
        dates = list(days)
        opens = {d: g["open"].to_dict() for d, g in days.items()}
        held: dict = {}
        equity, peak, worst, out = 1.0, 1.0, 0.0, []
        for k, (t, after) in enumerate(itertools.pairwise(dates), 1):
            day = days[t]
            ranked = day[day["place"].notna()].sort_values("place").index.tolist()
            stopped, present, risk = day["stopped"].to_dict(), set(day.index), day["risk"].to_dict()
            leave = []
            for code, p in held.items():
                if code in present and stopped[code]:
                    leave.append(code)
                    continue
                p["out"] = 0 if code in ranked else p["out"] + 1
                if p["out"] >= CONFIRM_DAYS:
                    leave.append(code)
            slots = max(0, len(ranked) - (len(held) - len(leave)))
            buys = [x for x in ranked if x not in held][:slots]
            for code in leave:
                if code in opens[after]:
                    held.pop(code)
            inverse = {x: 1.0 / max(risk[x], 1e-6) for x in buys}
            for code in buys:
                if code in opens[after]:
                    held[code] = {"out": 0, "weight": inverse[code] / (sum(inverse.values()) + 1e-12)}
            if k + 1 < len(dates):
                later = dates[k + 1]
                both = [(p["weight"], opens[after][x], opens[later][x]) for x, p in held.items() if x in opens[after] and x in opens[later] and p["weight"] > 0]
                total = sum(x[0] for x in both)
                ret = sum(x * (b / (a + 1e-12) - 1.0) for x, a, b in both) / total if total > 1e-12 else 0.0
                equity *= 1.0 + ret
                peak = max(peak, equity)
                drop = equity / (peak + 1e-12) - 1.0
                worst = min(worst, drop)
                out.append((pdf[by].iloc[0], after, later, ret, equity, drop, worst, len(held), len(buys), len(leave)))
        return pd.DataFrame(out, columns=[by, *[x.split(" ")[0] for x in _RISK.split(", ")]])

    return rows.groupBy(by).applyInPandas(folded, f"{by} {kind}, {_RISK}")


def live_orders(positions: DataFrame, preds: DataFrame, budget: float = RISK_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Orders of the latest day and the positions after them.

    positions: code, out_counter; preds: one day's date, code, pred_ret, pred_mae.  All joins, nothing is collected.
    """
    preds = add_risk(preds)
    top = top_prefix(candidate_pool(preds), budget)
    held = positions.join(preds.select("code", "pred_ret", "pred_mae", "score"), "code", "left").join(top.select("code", "place"), "code", "left")
    counter = F.when(F.col("place").isNotNull(), 0).otherwise(F.col("out_counter") + 1)
    stopped = F.coalesce(F.col("pred_mae") < HARD_STOP, F.lit(False))
    held = held.withColumn("out_counter", counter).withColumn("reason", F.when(stopped, "risk_hard_stop").when(F.col("out_counter") >= CONFIRM_DAYS, "out_of_topcap"))
    sells = held.where(F.col("reason").isNotNull()).select("code", F.lit("SELL").alias("side"), "reason", "pred_ret", "pred_mae", "score")
    stay = held.where(F.col("reason").isNull())
    slots = top.agg(F.count(F.lit(1)).alias("cap")).crossJoin(stay.agg(F.count(F.lit(1)).alias("stay")))  # one row each
    fresh = top.join(positions, "code", "left_anti").withColumn("_n", F.row_number().over(W.orderBy("place")))  # the prefix of one day
    fresh = fresh.join(F.broadcast(slots), F.col("_n") <= F.col("cap") - F.col("stay"))
    buys = fresh.select("code", F.lit("BUY").alias("side"), F.lit("enter_topcap").alias("reason"), "pred_ret", "pred_mae", "score")
    state = stay.select("code", "out_counter", F.lit("OPEN").alias("status")).unionByName(fresh.select("code", F.lit(0).alias("out_counter"), F.lit("PENDING_ENTRY").alias("status")))
    return sells.unionByName(buys), state


def bandit_weights(rewards: DataFrame, arms: int = 3) -> DataFrame:
    """Weights after each step of rewards (key, step, arm, reward): w = max(0.1, w + r) for the arm, then normalised.

    A fold in the JVM: the state is an array of ``arms`` numbers, per key.
    """
    steps = F.array_sort(F.collect_list(F.struct("step", "arm", "reward")))
    start = F.array(*[F.lit(1.0 / arms)] * arms)

    def moved(state, s):
        raised = F.transform(state, lambda x, i: F.when(i == s["arm"], F.greatest(F.lit(0.1), x + s["reward"])).otherwise(x))
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))

    return rewards.groupBy("key").agg(steps.alias("_s")).select("key", F.aggregate("_s", start, moved).alias("weights"))


