"""Queries of the top-N portfolio: simulations, variants, walk-forward runs, regimes, daily actions, and a simulation in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane import config as cf
from ticklane.operators import labels as lb
from ticklane.operators import metrics
from ticklane.operators import portfolio as pf
from ticklane.operators import signals as sg
from ticklane.plans import oracle as o
from ticklane.plans import signal_queries as sq
from ticklane.plans.indicator_queries import rounded
from ticklane.plans.trade_queries import _sim, clean, kept, ledger
from ticklane.sources import sinks
from ticklane.sources.scratch import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE[name] = sql


# ---- a simulation in SQL: one row a day, variant and window, whose state is a list of holdings -------------------------

_HOLD = "STRUCT(code BIGINT, sd DATE, ed DATE, price DOUBLE, score DOUBLE, w DOUBLE, strat VARCHAR, peak DOUBLE, days BIGINT)[]"
_REGIME = {
    "regime_switch": "CASE regime WHEN 'trend_ok' THEN 'quality_trend' WHEN 'range_bias' THEN 'pullback' ELSE 'pullback_quality_combo' END",
    "meta_switch_rsi_vol": "CASE WHEN regime = 'trend_ok' AND mrsi >= 58 AND mvol >= 1 THEN 'quality_trend' WHEN regime = 'trend_ok' AND mrsi >= 52 THEN 'pullback_quality_combo' WHEN regime = 'range_bias' OR mrsi < 48 THEN 'pullback' ELSE 'pullback_quality_combo' END",
}
_RULES = {
    "rank_drop": "y.r.rk > d.top_n * d.mult + d.buffer AND y.r.mf < greatest(d.floor_, y.score - d.drop_, y.score - 0.5 * d.drop_)",
    "score_fade": "NOT y.top AND y.r.mf < greatest(d.floor_, y.score - d.drop_)",
    "signal_off": "NOT y.top AND NOT y.r.sig AND y.r.mf < d.sfloor",
    "trend_break": "NOT y.top AND y.r.brk",
    "trail_exit": "y.peak / y.price - 1 >= d.tprofit AND (y.r.und OR coalesce(y.peak > y.price AND 1 - y.r.c / y.peak > greatest(d.tgive, d.tatr * y.r.atr), false))",
}


def _ladder() -> str:
    said = " ".join(f"WHEN '{style}' THEN CASE " + " ".join(f"WHEN {_RULES[x]} THEN '{x}'" for x in order) + " END" for style, order in pf.LADDERS.items())
    return f"CASE d.style {said} END"


def _mode(by: str, of: str, table: str) -> str:
    return f"SELECT {by}, arg_min(s, (-n, s)) AS st FROM (SELECT {by}, {of} AS s, count(*) AS n FROM {table} WHERE {of} IS NOT NULL GROUP BY ALL) GROUP BY ALL"


_REASON = " || '|' || ".join(f"'{k}=' || printf('%.1f', round({f}_score, 1))" for k, f in (("trend", "trend"), ("mom", "momentum"), ("mid", "medium_term"), ("signal", "signal"), ("quality", "quality"), ("value", "value_factor"), ("risk", "risk")))
_FAC = o.Chain(sq.sql_factors().parts, sq.sql_factors().at).table("SELECT * FROM {t}", "fac")
_FAC = _FAC.table(
    f"""SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(multifactor_score, 9) DESC NULLS LAST, code) AS rk, {sq.STRATEGY} AS strat, {_REASON} AS why,
    CASE WHEN s2_entry = 1 THEN s2_stop WHEN s1_entry = 1 THEN s1_stop WHEN s3_long_entry = 1 THEN s3_stop ELSE close - 1.5 * atr14 END AS stop, {sq.SIGNAL} AS sig, coalesce(close < ema20, false) AS und,
    coalesce(close < ema20 AND ema20 < ema50, false) OR coalesce(close < ema20 AND dist_high20 < -0.12, false) OR coalesce(ema20 < ema50 AND adx14 < 16, false) AS brk FROM fac""", "fa").table(
    _mode("date", "market_state_index", "fac"), "dm").table("SELECT date, coalesce(any_value(st), 'neutral') AS regime, median(rsi14) AS mrsi, median(rvol20) AS mvol FROM fac LEFT JOIN dm USING (date) GROUP BY date", "dq")


def simulation(chain: o.Chain, variants: dict[str, cf.Portfolio], windows: str, tag: str, only: str = "") -> o.Chain:
    """Table sim{tag} of the events of variants in windows (SQL of window_id, start, end); the chain has fa and dq.

    only: SQL of pairs (variant, window_id) to be simulated.
    """
    choices = list(pf._choices(variants))
    number = lambda x: f"{float(x)!r}::DOUBLE"
    said = []
    for k, (name, p) in enumerate(variants.items()):
        cells = [p.min_score, p.min_total_exposure, p.base_total_exposure, p.max_total_exposure, p.min_position_weight, p.max_position_weight, p.exit_rank_mult, p.turnover_buffer, p.floor, p.exit_score_drop, p.signal_floor, p.trail_min_open_profit, p.trail_giveback_pct, p.trail_atr_buffer]
        said.append(f"('{name}', {k}, {choices.index((p.strategy_profile, p.min_score, p.top_n))}, {p.top_n}, {p.min_hold_days}, {p.max_hold_days}, '{p.exit_style}', {', '.join(map(number, cells))})")
    chain = chain.table(f"SELECT * FROM (VALUES {', '.join(said)}) AS q(variant, vno, choice, top_n, minhold, maxhold, style, least_, low_, base_, high_, minw, maxw, mult, buffer, floor_, drop_, sfloor, tprofit, tgive, tatr)".replace("{", "{{").replace("}", "}}"), f"v{tag}")
    chain = chain.table(windows, f"wn{tag}")
    parts = []
    for k, (profile, least, most) in enumerate(choices):
        if profile in _REGIME:
            of = _REGIME[profile]
            score = f"CASE {of} WHEN 'quality_trend' THEN profile_score_quality_trend WHEN 'pullback' THEN profile_score_pullback ELSE profile_score_pullback_quality_combo END"
            mask = f"CASE {of} WHEN 'quality_trend' THEN {sq.STRONG} WHEN 'pullback' THEN {sq.NEAR} ELSE ({sq.STRONG} OR {sq.NEAR}) END"
        else:
            score, mask = f"profile_score_{profile}", sq.MASKS.get(profile, "true")
        parts.append(f"SELECT {k} AS choice, {most} AS most, date, code, {score} AS strategy_score, candidate_score, technical_score, market_state_index, why FROM fa JOIN dq USING (date) WHERE market_state_index IN ('trend_ok', 'neutral', 'range_bias') AND {mask} AND ({sq.SIGNAL} OR coalesce({score} >= {least}, false))")
    chain = chain.table(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY choice, date ORDER BY {sq.ORDER}) AS place, count(*) OVER (PARTITION BY choice, date) AS cand FROM ({' UNION ALL '.join(parts)})) WHERE place <= most", f"tp{tag}")
    chain = chain.table(_mode("choice, date", "market_state_index", f"tp{tag}"), f"ts{tag}")
    chain = chain.table(f"SELECT choice, date, any_value(cand) AS cand, avg(strategy_score) AS ms, any_value(st) AS st, list({{{{'code': code, 'sc': strategy_score, 'why': why}}}} ORDER BY place) AS tops FROM tp{tag} JOIN ts{tag} USING (choice, date) GROUP BY 1, 2", f"fg{tag}")
    line = "OVER (PARTITION BY window_id, code ORDER BY date)"
    chain = chain.table(f"SELECT window_id, fa.*, lead(open) {line} AS no_, lead(date) {line} AS nd_ FROM fa JOIN wn{tag} ON date >= start AND date < \"end\"", f"rw{tag}")
    chain = chain.table(f"SELECT window_id, date, min(nd_) AS after, map_from_entries(list((code, {{{{'c': close, 'atr': atr_pct, 'mf': multifactor_score, 'rk': rk, 'stop': stop, 'strat': strat, 'sig': sig, 'und': und, 'brk': brk, 'no': no_}}}}))) AS m FROM rw{tag} GROUP BY 1, 2", f"dy{tag}")
    chain = chain.table(
        f"""SELECT v.*, y.window_id, y.date, y.after, y.m, y.k, coalesce(g.cand, 0) AS cand, coalesce(g.tops, []) AS tops,
        CASE WHEN g.ms IS NULL THEN low_ ELSE least(greatest(CASE st WHEN 'trend_ok' THEN base_ + (high_ - base_) * q WHEN 'range_bias' THEN least(base_, 0.35) ELSE low_ + (base_ - low_) * q END, low_), high_) END AS target
        FROM v{tag} v JOIN (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY date) AS k FROM dy{tag} WHERE after IS NOT NULL) y ON true
        LEFT JOIN fg{tag} g ON g.choice = v.choice AND g.date = y.date, LATERAL (SELECT least(greatest((g.ms - least_) / greatest(92.0 - least_, 1e-6), 0), 1) AS q) {only}""", f"ds{tag}")  # fmt: skip
    step = f"""
    SELECT variant, window_id, k, held2, e2, sold, bought, date, after, target, cand, top_n, list_avg(list_transform(tops, lambda t: t.sc))
    FROM (SELECT *, list_transform(stay, lambda z: {{'code': z.code, 'sd': z.sd, 'ed': z.ed, 'price': z.price, 'score': z.score, 'w': z.w, 'strat': z.strat, 'peak': z.peak, 'days': z.days}})
                 || list_transform(bought, lambda b: {{'code': b.code, 'sd': date, 'ed': after, 'price': b.no, 'score': b.sc, 'w': b.w, 'strat': b.strat, 'peak': b.c, 'days': 0::BIGINT}}) AS held2,
                 equity * coalesce(list_product(list_transform(sold, lambda z: 1 + z.pnl * z.w)), 1) AS e2
          FROM (SELECT *, list_filter(list_transform(buys, lambda t, i: {{'code': t.code, 'sc': t.sc, 'why': t.why, 'no': m[t.code].no, 'c': m[t.code].c, 'strat': m[t.code].strat,
                                     'w': CASE WHEN room <= 0 THEN 0 ELSE least(least(greatest(raws[i] / list_sum(raws) * room, minw), maxw) * (room / greatest(list_sum(list_transform(raws, lambda x: least(greatest(x / list_sum(raws) * room, minw), maxw))), 1e-9)), maxw) END}}),
                                     lambda b: b.no IS NOT NULL AND b.w > 0) AS bought
                FROM (SELECT *, list_transform(buys, lambda t: greatest(coalesce(t.sc, least_) - least_, 1.0)) AS raws
                      FROM (SELECT *, greatest(0.0, target - coalesce(list_sum(list_transform(stay, lambda z: z.w)), 0)) AS room,
                                   list_filter(tops, lambda t: NOT list_contains(list_transform(stay, lambda z: z.code), t.code))[1:greatest(0, top_n - len(stay))] AS buys
                            FROM (SELECT *, list_filter(seen, lambda z: z.out_) AS sold, list_filter(seen, lambda z: NOT z.out_) AS stay
                                  FROM (SELECT d.*, equity, list_transform(list_transform(list_transform(held, lambda h: {{'code': h.code, 'sd': h.sd, 'ed': h.ed, 'price': h.price, 'score': h.score, 'w': h.w, 'strat': h.strat,
                                                      'peak': CASE WHEN d.m[h.code] IS NULL THEN h.peak ELSE greatest(h.peak, d.m[h.code].c) END, 'days': h.days + (d.m[h.code] IS NOT NULL)::BIGINT, 'r': d.m[h.code],
                                                      'top': list_contains(list_transform(d.tops, lambda t: t.code), h.code)}}),
                                                    lambda y: {{'y': y, 'why': CASE WHEN y.r IS NULL THEN NULL WHEN y.r.c < y.r.stop THEN 'hit_stop' WHEN y.days >= d.maxhold THEN 'max_hold' WHEN y.days < d.minhold THEN NULL ELSE {_ladder()} END}}),
                                                    lambda z: {{'code': z.y.code, 'sd': z.y.sd, 'ed': z.y.ed, 'price': z.y.price, 'score': z.y.score, 'w': z.y.w, 'strat': z.y.strat, 'peak': z.y.peak, 'days': z.y.days, 'why': z.why, 'no': z.y.r.no, 'mf': z.y.r.mf,
                                                      'pnl': (z.y.r.no - z.y.price) / z.y.price - 0.0004, 'out_': coalesce(z.why IS NOT NULL AND z.y.r.no IS NOT NULL, false)}}) AS seen
                                        FROM sim{tag} s JOIN ds{tag} d ON d.variant = s.variant AND d.window_id = s.window_id AND d.k = s.k + 1))))))"""  # noqa: E501
    sold = "STRUCT(code BIGINT, sd DATE, ed DATE, price DOUBLE, score DOUBLE, w DOUBLE, strat VARCHAR, peak DOUBLE, days BIGINT, why VARCHAR, no DOUBLE, mf DOUBLE, pnl DOUBLE, out_ BOOLEAN)[]"
    bought = "STRUCT(code BIGINT, sc DOUBLE, why VARCHAR, no DOUBLE, c DOUBLE, strat VARCHAR, w DOUBLE)[]"
    start = f"SELECT DISTINCT variant, window_id, 0::BIGINT AS k, CAST([] AS {_HOLD}) AS held, 1.0::DOUBLE AS equity, CAST([] AS {sold}) AS sold, CAST([] AS {bought}) AS bought, NULL::DATE AS date, NULL::DATE AS after, NULL::DOUBLE AS target, NULL::BIGINT AS cand, NULL::INT AS top_n, NULL::DOUBLE AS avg_top FROM ds{tag}"
    chain = chain.table(f"{start} UNION ALL {step}".replace("{", "{{").replace("}", "}}"), f"sim{tag}")
    return chain.table(
        f"SELECT variant, window_id, x.code, x.strat AS strategy, x.sd AS entry_signal_date, x.ed AS entry_date, x.price AS entry_price, after AS exit_date, x.no AS exit_price, x.pnl AS pnl_pct, x.days AS days_held, x.score AS entry_score, x.w AS weight, x.mf AS exit_score, x.why AS exit_reason, date FROM (SELECT variant, window_id, date, after, unnest(sold) AS x FROM sim{tag})", f"tr{tag}").table(
        f"SELECT variant, window_id, date AS signal_date, exit_date AS execute_date, code, 'SELL' AS side, exit_price AS price, weight, exit_score AS score, strategy, exit_reason AS reason FROM tr{tag} UNION ALL SELECT variant, window_id, date, after, b.code, 'BUY', b.no, b.w, b.sc, b.strat, b.why FROM (SELECT variant, window_id, date, after, unnest(bought) AS b FROM sim{tag})", f"od{tag}")


_ALL = "SELECT 'all' AS window_id, DATE '1900-01-01' AS start, DATE '9999-01-01' AS \"end\""


def span(start: str, end: str, windows: str = "walk") -> str:
    return f'SELECT window_id, {start} AS start, {end} AS "end" FROM {windows}'


def metrics_sql(tag: str) -> str:
    """Metrics of every variant and window of a simulation, as variant_metrics() has them."""
    return f"""SELECT v.variant, w.window_id, v.vno, avg((pnl_pct > 0)::INT) AS hit_rate, avg(pnl_pct) AS expectancy, count(pnl_pct) AS trade_count, avg(days_held) AS avg_hold_days,
    CASE WHEN count(pnl_pct) = 0 THEN -1e9 ELSE avg((pnl_pct > 0)::INT) * 100 + avg(pnl_pct) * 1000 + least(count(pnl_pct), 300) * 0.01 END AS score
    FROM v{tag} v JOIN wn{tag} w ON true LEFT JOIN tr{tag} t ON t.variant = v.variant AND t.window_id = w.window_id GROUP BY 1, 2, 3"""


_BEST = "SELECT window_id, arg_min(variant, (-round(score, 9), vno)) AS variant FROM {m} GROUP BY window_id"

# ---- simulations -------------------------------------------------------------------------------------------------------

_P = cf.Portfolio()
_ONE = simulation(_FAC, {"blended": _P}, _ALL, "")
_TRADE = ["entry_price", "exit_price", "pnl_pct", "entry_score", "weight", "exit_score"]
_TRADE_KEYS = ("variant", "code", "strategy", "entry_signal_date", "entry_date", "exit_date", "days_held", "exit_reason")


#: What simulations and actions read of a factor panel; profile scores and reasons follow from the factors' scores.
_READ = (
    "code", "date", "rn", "close", "next_open", "next_date", "atr_pct", "stop", "strategy", "signal", "under", "breakdown", *[f"fits_{p}" for p in sg.MASKED], "market_state_index", "candidate_score", "technical_score",
    "rank_today", *[f"{f}_score" for f in cf.FACTORS])
#: What the features of windows and switched profiles read beside it.
_MIDDLE = ("rsi14", "rvol20", "adx14", "roc20")


def factors(s: SparkSession, d: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The panel that simulations read several times: made once, narrow; scores that are sums of others are made when it is read."""
    made = sg.factor_panel(sq.bars(s, d), own=pf.bar_columns(), read=(), ahead=pf.ahead_columns()).withColumns(pf.day_columns())
    return sg.add_multifactor(kept(s, made.select(*_READ, *more), "factors"))


def events(s: SparkSession, d: str, variants: dict | None = None) -> DataFrame:
    variants = variants or {"blended": _P}
    switched = any(p.strategy_profile in sg.SWITCHED for p in variants.values())
    return pf.simulate(factors(s, d, ("rsi14", "rvol20") if switched else ()), variants)


def _shown(columns: list[str], keys, table: str, where: str = "") -> str:
    return f"SELECT {', '.join([*keys, *[f'round({x}, 6) AS {x}' for x in columns]])} FROM {table} {where}"


register("portfolio_sim_trades", lambda s, d: rounded(clean(pf.trades(events(s, d))), _TRADE, _TRADE_KEYS), _ONE.end(_shown(_TRADE, [x if x != "days_held" else "CAST(days_held AS INT) AS days_held" for x in _TRADE_KEYS], "tr")))
_ORDER_KEYS = ("variant", "signal_date", "execute_date", "code", "side", "strategy", "reason")
register("portfolio_sim_orders", lambda s, d: rounded(clean(pf.orders(events(s, d))), ["price", "weight", "score"], _ORDER_KEYS), _ONE.end(_shown(["price", "weight", "score"], _ORDER_KEYS, "od")))
register("portfolio_sim_monitor", lambda s, d: rounded(clean(pf.of_kind(events(s, d), "monitor", pf.MONITOR)), pf.MONITOR[4:], ("variant", *pf.MONITOR[:4])),
         _ONE.end("SELECT variant, date AS signal_date, cand AS candidate_count, top_n, CAST(len(held) AS INT) AS held_count, round(target, 6) AS target_exposure, round(coalesce(list_sum(list_transform(held, lambda h: h.w)), 0), 6) AS realized_exposure, round(avg_top, 6) AS avg_top_score, round(list_avg(list_transform(held, lambda h: h.score)), 6) AS avg_held_score FROM sim WHERE k > 0"))
register("portfolio_sim_equity", lambda s, d: rounded(clean(pf.of_kind(events(s, d), "equity", pf.EQUITY)), ["equity", "cash_weight"], ("variant", "exit_date", "held_count")),
         _ONE.end("SELECT variant, after AS exit_date, CAST(len(held) AS INT) AS held_count, round(equity, 6) AS equity, round(greatest(0.0, 1 - coalesce(list_sum(list_transform(held, lambda h: h.w)), 0)), 6) AS cash_weight FROM sim WHERE k > 0"))
register("portfolio_summary", lambda s, d: rounded(pf.summary(pf.trades(events(s, d))), ["value"], ("variant", "metric")),
         _ONE.end("SELECT variant, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT variant, count(*)::DOUBLE AS trades, avg((pnl_pct > 0)::INT) AS hit_rate, avg(pnl_pct) AS expectancy, avg(days_held) AS avg_hold_days, avg(entry_score) AS avg_entry_score FROM tr GROUP BY 1) ON trades, hit_rate, expectancy, avg_hold_days, avg_entry_score INTO NAME metric VALUE value)"))


def variant_summary(s: SparkSession, d: str) -> DataFrame:
    """Metrics of all variants of the full set over the whole panel."""
    found = pf.variant_metrics(pf.trades(events(s, d, cf.VARIANTS)), None, cf.VARIANTS)
    return rounded(found, ["hit_rate", "expectancy", "avg_hold_days", "score"], ("variant", "trade_count"))


_FULL = simulation(_FAC, cf.VARIANTS, _ALL, "")
_METRICS = ["hit_rate", "expectancy", "avg_hold_days"]
register("variant_summary", variant_summary, _FULL.end(_shown([*_METRICS, "score"], ("variant", "trade_count"), f"({metrics_sql('')})")))


def exit_variants(s: SparkSession, d: str) -> DataFrame:
    """Metrics of the variants of every smaller set, named set/variant."""
    found = pf.variant_metrics(pf.trades(events(s, d, _OTHERS)), None, _OTHERS)
    return rounded(found, ["hit_rate", "expectancy", "avg_hold_days", "score"], ("variant", "trade_count"))


_OTHERS = {f"{name}/{v}": p for name, some in cf.VARIANT_SETS.items() if name != "full" for v, p in some.items()}
register("variant_sets", exit_variants, simulation(_FAC, _OTHERS, _ALL, "").end(_shown([*_METRICS, "score"], ("variant", "trade_count"), f"({metrics_sql('')})")))

# ---- walk-forward and regimes ------------------------------------------------------------------------------------------

_SPANS = {"train": 36, "val": 3, "test": 12, "step": 12}
_REGIME_SPANS = {"train": 24, "val": 3, "test": 6, "step": 6}


def windows(s: SparkSession, bars_: DataFrame, **spans: int) -> DataFrame:
    first, last = bars_.agg(F.min("date"), F.max("date")).first()
    return lb.walk_windows(s, first, last, **spans)


def walk_sql(chain: o.Chain, train: int, val: int, test: int, step: int) -> o.Chain:
    month = lambda x, n: f"CAST({x} + INTERVAL ({n}) MONTH AS DATE)"
    return chain.table("SELECT min(date) AS a, max(date) AS b FROM bars", "span_").table(
        f"SELECT 0 AS window_id, a AS train_start FROM span_ UNION ALL SELECT window_id + 1, {month('train_start', step)} FROM w0 WHERE window_id < 100", "w0").table(
        f"SELECT *, {month('val_start', val)} AS test_start FROM (SELECT *, {month('train_start', train)} AS val_start FROM w0)", "w1").table(
        f"SELECT * FROM (SELECT *, {month('test_start', test)} AS test_end FROM w1) WHERE test_end <= (SELECT b FROM span_)", "walk")


def walkforward_portfolio(s: SparkSession, d: str) -> DataFrame:
    """All variants of the full set: the best one of each validation span, tested."""
    f = factors(s, d)
    found = pf.walk_forward(f, windows(s, f, **_SPANS), cf.VARIANTS)
    return rounded(found, _METRICS, ("window_id", "variant", "val_start", "val_end", "test_start", "test_end", "trade_count"))


_walked = simulation(walk_sql(_FAC, **_SPANS), cf.VARIANTS, span("val_start", "test_start"), "a").table(metrics_sql("a"), "ma").table(_BEST.format(m="ma"), "pick")
_walked = simulation(_walked, cf.VARIANTS, span("test_start", "test_end"), "b", "WHERE (v.variant, y.window_id) IN (SELECT (variant, window_id) FROM pick)").table(metrics_sql("b"), "mb")
register("walkforward_portfolio", walkforward_portfolio,
         _walked.end("SELECT window_id, variant, val_start, test_start AS val_end, test_start, test_end, trade_count, " + ", ".join(f"round({x}, 6) AS {x}" for x in _METRICS) + " FROM pick JOIN walk USING (window_id) JOIN mb USING (window_id, variant)"))
_BASE = cf.VARIANT_SETS["combo_compare"]
_FEATURES = ["trend_share", "range_share", "neutral_share", "rsi", "rvol", "adx", "atr", "roc", "quality", "signal"]


def regime_metrics(s: SparkSession, d: str) -> DataFrame:
    f = factors(s, d, _MIDDLE)
    return kept(s, pf.regime_variants(f, windows(s, f, **_REGIME_SPANS)), "regimes")


def features_sql(chain: o.Chain, windows_: str) -> o.Chain:
    """Table ft: the features of each window (SQL of window_id, start, end)."""
    middle = {"rsi": "rsi14", "rvol": "rvol20", "adx": "adx14", "atr": "atr_pct", "roc": "roc20"}
    return chain.table(windows_, "fw").table(
        "SELECT date, regime AS state, " + ", ".join(f"median({x}) AS {k}" for k, x in middle.items()) + ", avg(quality_score) AS quality, avg(signal_score) AS signal FROM fa JOIN dq USING (date) GROUP BY 1, 2", "fd").table(
        "SELECT window_id, avg((state = 'trend_ok')::INT) AS trend_share, avg((state = 'range_bias')::INT) AS range_share, avg((state = 'neutral')::INT) AS neutral_share, " + ", ".join(f"median({k}) AS {k}" for k in middle) + ', avg(quality) AS quality, avg(signal) AS signal FROM fd JOIN fw ON date >= start AND date < "end" GROUP BY 1', "ft")


_LABEL = "CASE WHEN trend_share >= 0.45 AND rsi >= 56 AND quality >= 55 THEN 'quality_trend_regime' WHEN trend_share >= 0.30 AND rsi >= 49 AND rsi <= 58 AND rvol <= 1.20 THEN 'pullback_regime' WHEN trend_share >= 0.20 AND rsi >= 52 AND rvol >= 0.95 AND signal >= 50 THEN 'combo_regime' WHEN range_share >= 0.25 OR rsi < 48 THEN 'weak_range_regime' ELSE 'mixed_transition' END"
_regime = features_sql(walk_sql(_FAC, **_REGIME_SPANS), span("val_start", "test_start"))
_regime = simulation(_regime, _BASE, span("test_start", "test_end"), "b").table(metrics_sql("b"), "mb").table(f"SELECT *, {_LABEL} AS regime FROM ft JOIN mb USING (window_id)", "rm")
register("regime_variants", lambda s, d: rounded(regime_metrics(s, d), [*_METRICS, "score", *_FEATURES], ("window_id", "variant", "regime", "val_start", "val_end", "test_start", "test_end", "trade_count")),
         _regime.end("SELECT window_id, variant, regime, val_start, test_start AS val_end, test_start, test_end, trade_count, " + ", ".join(f"round({x}, 6) AS {x}" for x in [*_METRICS, "score", *_FEATURES]) + " FROM rm JOIN walk USING (window_id)"))
_stable = _regime.table(_BEST.format(m="rm"), "pick").table("SELECT regime, variant, count(*) AS win_count FROM pick JOIN rm USING (window_id, variant) GROUP BY 1, 2", "wins")
_STABLE = ["hit_rate", "expectancy", "trade_count", "avg_hold_days", "score"]
_stable_sql = "SELECT regime, variant, coalesce(any_value(win_count), 0) AS win_count, " + ", ".join(f"round(avg({x}), 6) AS {x}" for x in _STABLE) + " FROM rm LEFT JOIN wins USING (regime, variant) GROUP BY 1, 2"
register("regime_stability", lambda s, d: rounded(pf.regime_stability(regime_metrics(s, d)), _STABLE, ("regime", "variant", "win_count")), _stable.end(_stable_sql))


def regime_summary(s: SparkSession, d: str) -> DataFrame:
    """The summary with the place each row has in its order."""
    rows = pf.regime_stability(regime_metrics(s, d))
    place = F.row_number().over(W.orderBy("regime", F.col("win_count").desc(), F.col("expectancy").desc_nulls_last(), "variant"))  # a row a regime and variant
    return rounded(rows.withColumn("place", place), _STABLE, ("place", "regime", "variant", "win_count"))


register("regime_summary", regime_summary, _stable.end(f"SELECT CAST(row_number() OVER (ORDER BY regime, win_count DESC, expectancy DESC NULLS LAST, variant) AS INT) AS place, * FROM ({_stable_sql})"))


def regime_windows(s: SparkSession, d: str) -> DataFrame:
    months = sq.factors(s, d, ("market_state_index", "rsi14", "rvol20", "adx14", "atr_pct", "roc20")).withColumn("window_id", F.trunc("date", "quarter"))
    feats = pf.window_features(months, ["window_id"]).withColumns({x: F.round(x, 6) for x in _FEATURES})
    return feats.withColumn("regime", pf.regime_label())


_quarters = features_sql(_FAC.table("SELECT DISTINCT CAST(date_trunc('quarter', date) AS DATE) AS q FROM bars", "qs"), 'SELECT q AS window_id, q AS start, CAST(q + INTERVAL 3 MONTH AS DATE) AS "end" FROM qs').table("SELECT window_id, " + ", ".join(f"round({x}, 6) AS {x}" for x in _FEATURES) + " FROM ft", "fr")
register("window_features", lambda s, d: regime_windows(s, d).drop("regime"), _quarters.end("SELECT * FROM fr"))
register("regime_label", lambda s, d: regime_windows(s, d).select("window_id", "regime", pf.profile_of_regime(F.col("regime")).alias("profile")),
         _quarters.end(f"SELECT window_id, regime, CASE regime WHEN 'weak_range_regime' THEN 'pullback_quality_combo' WHEN 'quality_trend_regime' THEN 'quality_trend' ELSE 'pullback' END AS profile FROM (SELECT *, {_LABEL} AS regime FROM fr)"))


def meta_history(s: SparkSession, d: str) -> DataFrame:
    """Quarters with their features and the ledger's best strategy in each."""
    trades = ledger(s, d).withColumns({"variant": F.col("strategy"), "window_id": F.trunc("entry_date", "quarter")})
    found = metrics.trade_metrics(trades, ["variant", "window_id"]).withColumn("score", F.round(F.col("hit_rate") * 100 + F.col("expectancy") * 1000, 6))
    best = found.groupBy("window_id").agg(F.max_by("variant", F.struct("score", "variant")).alias("best_variant"), F.max("score").alias("label_score"))
    rows = regime_windows(s, d).join(best, "window_id").withColumn("window", F.row_number().over(W.orderBy("window_id")))  # a row a quarter
    return rows.withColumn("fallback", F.lit("S1"))


_PICK = ["trend_share", "range_share", "rsi", "rvol"]
_meta = o.beside(_sim.table("SELECT * FROM {t}", "trades"), _quarters).table(
    "SELECT window_id, arg_max(variant, (score, variant)) AS best_variant, max(score) AS label_score FROM (SELECT strategy AS variant, CAST(date_trunc('quarter', entry_date) AS DATE) AS window_id, round(avg((pnl_pct > 0)::INT) * 100 + avg(pnl_pct) * 1000, 6) AS score FROM trades GROUP BY 1, 2) GROUP BY 1", "bs").table(
    "SELECT *, row_number() OVER (ORDER BY window_id) AS win FROM fr JOIN bs USING (window_id)", "hs").table(
    "SELECT a.win, b.win AS p, b.best_variant, b.label_score, count(*) OVER (PARTITION BY a.win) AS past, " + ", ".join(
        f"a.{f} AS a_{f}, b.{f} AS b_{f}, CASE WHEN quantile_cont(b.{f}, 0.75) OVER q > quantile_cont(b.{f}, 0.25) OVER q THEN quantile_cont(b.{f}, 0.75) OVER q - quantile_cont(b.{f}, 0.25) OVER q ELSE 1 END AS u_{f}" for f in _PICK) + " FROM hs a JOIN hs b ON b.win < a.win WINDOW q AS (PARTITION BY a.win)", "pr").table(
    "SELECT *, row_number() OVER (PARTITION BY win ORDER BY dist, label_score DESC NULLS LAST, p) AS n FROM (SELECT *, round(sqrt(" + " + ".join(f"((a_{f} - b_{f}) / u_{f}) ** 2" for f in _PICK) + "), 9) AS dist FROM pr)", "nr").table(
    "SELECT win, arg_min(best_variant, (-round(v, 9), f)) AS won FROM (SELECT win, best_variant, sum(1 / greatest(dist, 0.05)) AS v, min(n) AS f FROM nr WHERE n <= 5 AND past >= 6 GROUP BY 1, 2) GROUP BY 1", "wo")
register("meta_pick", lambda s, d: pf.meta_pick(meta_history(s, d), _PICK), _meta.end("SELECT CAST(win AS INT) AS \"window\", coalesce(won, 'S1') AS picked FROM hs LEFT JOIN wo USING (win)"))


def meta_selector(s: SparkSession, d: str) -> DataFrame:
    f = factors(s, d, _MIDDLE)
    found = pf.walk_forward_meta(f, windows(s, f, train=12, val=3, test=3, step=3))
    return rounded(found, _METRICS, ("window_id", "variant", "selected_variant", "trade_count"))


register("walkforward_meta", meta_selector)

# ---- daily actions -----------------------------------------------------------------------------------------------------


def daily(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return pf.daily_run(factors(s, d, _MIDDLE), recent_days=60, cut=lambda df: kept(s, df, "daily"))


_ACTION = ["target_weight", "entry_price", "current_price", "pnl_pct"]
_day = features_sql(_FAC.table("SELECT max(date) AS d FROM fa", "ld").table("SELECT max(date) AS d FROM fa WHERE date < (SELECT d FROM ld)", "pd"), 'SELECT 0 AS window_id, CAST(d - INTERVAL 3 MONTH AS DATE) AS start, CAST(d + INTERVAL 1 DAY AS DATE) AS "end" FROM ld').table(
    f"SELECT CASE regime WHEN 'weak_range_regime' THEN 'pullback_quality_combo' WHEN 'quality_trend_regime' THEN 'quality_trend' ELSE 'pullback' END AS profile FROM (SELECT {_LABEL} AS regime FROM ft)", "prof")
_day = simulation(_day, cf.DAILY, _ALL, "").table("SELECT h.* FROM (SELECT unnest(held) AS h FROM (SELECT arg_max(held, k) AS held FROM sim WHERE variant = (SELECT profile FROM prof)))", "hd").table(
    """SELECT t.code, t.place, t.why, v.*, greatest(coalesce(t.strategy_score, least_) - least_, 1) AS raw,
    least(greatest(CASE g.st WHEN 'trend_ok' THEN base_ + (high_ - base_) * q WHEN 'range_bias' THEN least(base_, 0.35) ELSE low_ + (base_ - low_) * q END, low_), high_) AS target
    FROM tp t JOIN fg g ON g.choice = t.choice AND g.date = t.date JOIN v ON v.choice = t.choice AND v.variant = (SELECT profile FROM prof),
    LATERAL (SELECT least(greatest((g.ms - least_) / greatest(92.0 - least_, 1e-6), 0), 1) AS q) WHERE t.date = (SELECT d FROM pd)""", "c0").table(
    "SELECT *, least(greatest(raw / sum(raw) OVER () * target, minw), maxw) AS w1 FROM c0", "c1").table(
    "SELECT c1.code, c1.place, c1.top_n, c1.why, least(w1 * target / greatest(sum(w1) OVER (), 1e-9), maxw) AS tw, f.strat, f.close FROM c1 JOIN fa f ON f.code = c1.code AND f.date = (SELECT d FROM pd)", "cd").table(
    """SELECT h.code, 'HOLD' AS action, CASE WHEN c.strat IS NOT NULL THEN c.tw ELSE h.w END AS target_weight, coalesce(c.strat, h.strat) AS strategy, h.ed AS entry_date, h.price AS entry_price, f.close AS current_price,
    CASE WHEN h.price > 0 THEN f.close / h.price - 1 END AS pnl_pct, 'existing_position_hold' AS reason FROM hd h LEFT JOIN cd c ON c.code = h.code LEFT JOIN fa f ON f.code = h.code AND f.date = (SELECT d FROM ld)
    UNION ALL SELECT code, 'BUY', tw, strat, NULL, NULL, close, NULL, why FROM (SELECT *, row_number() OVER (ORDER BY place) AS n FROM cd WHERE code NOT IN (SELECT code FROM hd)) WHERE n <= greatest(top_n - (SELECT count(*) FROM hd), 0)""", "na")  # fmt: skip
_ACTION_KEYS = ("code", "action", "strategy", "entry_date", "reason")
register("net_actions", lambda s, d: rounded(clean(daily(s, d)["actions"]), _ACTION, _ACTION_KEYS), _day.end(_shown(_ACTION, _ACTION_KEYS, "na")))
_HISTORY_KEYS = ("action_date", "action", "code", "strategy", "reason")
register("action_history", lambda s, d: rounded(clean(daily(s, d)["history"]), ["target_weight", "pnl_pct"], _HISTORY_KEYS),
         _day.end("""SELECT o.execute_date AS action_date, o.side AS action, o.code, o.strategy, o.reason, round(o.weight, 6) AS target_weight, CASE WHEN o.side = 'SELL' THEN round(t.pnl_pct, 6) END AS pnl_pct
         FROM od o LEFT JOIN tr t ON o.side = 'SELL' AND t.variant = o.variant AND t.code = o.code AND t.exit_date = o.execute_date WHERE o.variant = (SELECT profile FROM prof) AND o.execute_date BETWEEN (SELECT d - INTERVAL 60 DAY FROM ld) AND (SELECT d FROM ld)
         UNION ALL SELECT (SELECT d FROM ld), action, code, strategy, reason, round(target_weight, 6), round(pnl_pct, 6) FROM na WHERE action = 'HOLD'"""))  # fmt: skip


def daily_tables(s: SparkSession, d: str) -> DataFrame:
    """Rows and dates of each of the 11 tables of the daily run, as they are read back from the version that was written."""
    folder = scratch_path(s, "runs")
    sinks.save_run(s, daily(s, d), folder)
    day = {"regime": "as_of_date", "history": "action_date", "panel": "date", "trades": "exit_date", "monitor": "signal_date", "equity": "exit_date", "orders": "execute_date", "positions": "entry_date"}
    of = lambda n, df: df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), *[f(F.col(day[n]) if n in day else F.lit(None)).cast("date").alias(a) for a, f in (("first", F.min), ("last", F.max))])
    return reduce(DataFrame.unionByName, [of(n, df) for n, df in sinks.load_run(s, folder).items()])


_of = lambda n, rows, day="NULL": f"SELECT '{n}' AS name, count(*) AS n, CAST(min({day}) AS DATE) AS first, CAST(max({day}) AS DATE) AS last FROM ({rows})"
_mine = "WHERE variant = (SELECT profile FROM prof)"
register("daily_tables", daily_tables, _day.end(" UNION ALL ".join([
    _of("regime", "SELECT d FROM ld", "d"), _of("actions", "SELECT * FROM na"), _of("panel", "SELECT date FROM fa", "date"), _of("trades", f"SELECT exit_date FROM tr {_mine}", "exit_date"), _of("orders", f"SELECT execute_date FROM od {_mine}", "execute_date"),
    _of("candidates", "SELECT * FROM cd"), _of("positions", "SELECT ed FROM hd", "ed"), _of("summary", "SELECT unnest(range(5)) FROM range(1)"),
    _of("history", f"""SELECT execute_date AS day FROM od {_mine} AND execute_date BETWEEN (SELECT d - INTERVAL 60 DAY FROM ld) AND (SELECT d FROM ld) UNION ALL SELECT (SELECT d FROM ld) FROM na WHERE action = 'HOLD'""", "day"),
    _of("monitor", f"SELECT date FROM sim {_mine} AND k > 0", "date"), _of("equity", f"SELECT after FROM sim {_mine} AND k > 0", "after")])))
