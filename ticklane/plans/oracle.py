"""SQL (DuckDB) that says independently what the registered queries compute: chains of projections over the test bars."""

from __future__ import annotations

BARS = """
d AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, count(*) AS n, sum(CAST(round(l_discount*100) AS BIGINT)) AS sd,
         sum(CAST(round(l_tax*100) AS BIGINT)) AS st, max(CAST(round(l_discount*100) AS BIGINT)) AS hx, min(CAST(round(l_discount*100) AS BIGINT)) AS mn,
         sum(CAST(l_quantity AS BIGINT))*100 AS volume
  FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(CAST(floor((sd - 5*n)*6e1/n) AS BIGINT)) OVER (PARTITION BY code ORDER BY date) AS cum FROM d),
p AS (SELECT *, floor(1e4*exp(cum/1e4) + 5e-1)/1e2 AS close FROM c),
q AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY code ORDER BY date), 1e2) AS preclose FROM p),
o AS (SELECT *, floor(preclose*(1e0 + 1e-3*(st - 4*n)/n)*1e2 + 5e-1)/1e2 AS open FROM q),
bars AS MATERIALIZED (
  SELECT CAST(code AS BIGINT) AS code, date, open, floor(greatest(open,close)*(1e0 + 1e-3*hx)*1e2 + 5e-1)/1e2 AS high,
         floor(least(open,close)*(1e0 - 1e-3*mn)*1e2 + 5e-1)/1e2 AS low, close, preclose, CAST(volume AS DOUBLE) AS volume, volume*close AS amount,
         volume/1e6 AS turnover, (close/preclose - 1e0)*1e2 AS pct_chg,
         CASE WHEN code % 13 = 0 THEN NULL WHEN code % 11 = 0 THEN -close/1e2 ELSE close/(2e1 + code % 37) END AS pb_mrq,
         CASE WHEN code % 17 = 0 THEN NULL ELSE close/(3e1 + code % 23) END AS ps_ttm,
         row_number() OVER (PARTITION BY code ORDER BY date) AS rn
  FROM o)"""

LINE = "PARTITION BY code ORDER BY date"
UPTO = f"OVER ({LINE} ROWS UNBOUNDED PRECEDING)"


def over(n: int) -> str:
    return f"OVER ({LINE} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ahead(n: int) -> str:
    return f"OVER ({LINE} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def full(x: str, n: int, made: str) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {made} {over(n)} END"


def sma(x: str, n: int) -> str:
    return full(x, n, f"avg({x})")


def top(x: str, n: int) -> str:
    return full(x, n, f"max({x})")


def bottom(x: str, n: int) -> str:
    return full(x, n, f"min({x})")


def total(x: str, n: int) -> str:
    return full(x, n, f"sum({x})")


def std(x: str, n: int) -> str:
    return full(x, n, f"stddev_samp({x})")


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({LINE})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({LINE})"


def div(x: str, y: str) -> str:
    return f"(({x}) / nullif({y}, 0))"


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) < {low} THEN {low} WHEN ({x}) > {high} THEN {high} ELSE ({x}) END"


class Chain:
    """Common table expressions, each the one before with columns added."""

    def __init__(self, parts: list[str] | None = None, at: str = "bars"):
        self.parts, self.at = parts if parts is not None else [BARS.strip()], at

    def add(self, **columns: str) -> Chain:
        name = f"t{len(self.parts)}"
        said = ", ".join(f"{e} AS {k}" for k, e in columns.items())
        return Chain([*self.parts, f"{name} AS (SELECT *, {said} FROM {self.at})"], name)

    def table(self, sql: str, name: str | None = None, once: bool = False) -> Chain:
        """A further expression; {t} is the one before. Without a name it becomes the current one. once: made once, whoever reads it."""
        made = name or f"t{len(self.parts)}"
        return Chain([*self.parts, f"{made} AS {'MATERIALIZED ' if once else ''}({sql.format(t=self.at)})"], self.at if name else made)

    def end(self, sql: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(self.parts) + "\n" + sql.format(t=self.at)

    def show(self, columns: list[str], where: str = "", plain: tuple[str, ...] = ("code", "date"), places: int = 6) -> str:
        said = ", ".join([*plain, *[f"round({x}, {places}) AS {x}" for x in columns]])
        return self.end(f"SELECT {said} FROM {{t}}" + (f" WHERE {where}" if where else ""))


def beside(first: Chain, second: Chain) -> Chain:
    """The tables of both; numbered ones of the second that the first lacks get names of their own. The second is current."""
    import re

    fresh = [p for p in second.parts if p not in first.parts]
    names = {m[1] for p in fresh if (m := re.match(r"(t\d+) AS", p))}
    mine = lambda text: re.sub(r"\bt\d+\b", lambda m: f"u{m[0][1:]}" if m[0] in names else m[0], text)
    return Chain([*first.parts, *map(mine, fresh)], mine(second.at))


def ewm(chain: Chain, source: str, name: str, alpha: str, least: int) -> Chain:
    """Exponential mean by recursion over the rows that have a value (null before its first one only)."""
    k = len(chain.parts)
    chain = chain.table(f"SELECT code, date, {source} AS x, row_number() OVER ({LINE}) AS k FROM {{t}} WHERE {source} IS NOT NULL", f"x{k}")
    chain = chain.table(f"SELECT code, date, k, x AS y FROM x{k} WHERE k = 1 UNION ALL SELECT x.code, x.date, x.k, (1 - {alpha}) * r.y + {alpha} * x.x FROM r{k} r JOIN x{k} x ON x.code = r.code AND x.k = r.k + 1", f"r{k}")
    return chain.table(f"SELECT b.*, CASE WHEN r.k >= {least} THEN r.y END AS {name} FROM {{t}} b LEFT JOIN r{k} r USING (code, date)")


def psar(chain: Chain) -> Chain:
    k = len(chain.parts)
    chain = chain.table(f"SELECT code, date, rn, high, low, lag(high) OVER ({LINE}) AS ph, lag(low) OVER ({LINE}) AS pl FROM {{t}}", f"x{k}")
    chain = chain.table(
        f"""SELECT code, date, rn, true AS bull, 0.02::DOUBLE AS af, low AS ep, low AS stop FROM x{k} WHERE rn = 1
        UNION ALL
        SELECT code, date, rn, CASE WHEN hit THEN NOT bull ELSE bull END,
               CASE WHEN hit THEN 0.02 WHEN moved THEN least(af + 0.02, 0.2) ELSE af END,
               CASE WHEN hit THEN CASE WHEN bull THEN low ELSE high END WHEN moved THEN CASE WHEN bull THEN high ELSE low END ELSE ep END,
               CASE WHEN hit THEN ep ELSE reach END
        FROM (SELECT *, CASE WHEN bull THEN low < reach ELSE high > reach END AS hit, CASE WHEN bull THEN high > ep ELSE low < ep END AS moved
              FROM (SELECT x.code, x.date, x.rn, x.high, x.low, r.bull, r.af, r.ep,
                           CASE WHEN r.bull THEN least(r.stop + r.af * (r.ep - r.stop), x.pl) ELSE greatest(r.stop + r.af * (r.ep - r.stop), x.ph) END AS reach
                    FROM r{k} r JOIN x{k} x ON x.code = r.code AND x.rn = r.rn + 1))""",
        f"r{k}",
    )
    return chain.table(f"SELECT b.*, r.stop AS psar FROM {{t}} b JOIN r{k} r USING (code, date)")


TR = f"greatest(high - low, abs(high - {lag('close')}), abs({lag('close')} - low))"
LIST = "list({x}) FILTER (WHERE {x} IS NOT NULL) " + "{o}"


def pct_max(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN len(list_filter(list({x}) {over(n)}, lambda v: v <= {x})) / {float(n)} END"


def pct_avg(x: str, n: int, least: int | None = None) -> str:
    values = f"list({x}) {over(n)}"
    return (
        f"CASE WHEN count({x}) {over(n)} >= {least or n} AND {x} IS NOT NULL THEN (len(list_filter({values}, lambda v: v < {x})) "
        f"+ (len(list_filter({values}, lambda v: v = {x})) + 1) / 2.0) / count({x}) {over(n)} END"
    )


def add_atr(chain: Chain, n: int = 14, name: str = "atr14") -> Chain:
    return chain.add(_tr=TR).add(**{name: sma("_tr", n)})


def add_rsi(chain: Chain) -> Chain:
    chain = chain.add(_step=f"coalesce(close - {lag('close')}, 0)").add(_up="greatest(_step, 0)", _down="greatest(-_step, 0)")
    chain = chain.add(_rs=div(sma("_up", 14), f"({sma('_down', 14)})"))
    return chain.add(rsi14=clip("100 - 100 / (1 + _rs)", 0.0, 100.0))


def add_macd(chain: Chain) -> Chain:
    chain = ewm(ewm(chain, "close", "_e12", "(2.0/13)::DOUBLE", 12), "close", "_e26", "(2.0/27)::DOUBLE", 26).add(macd_dif="_e12 - _e26")
    return ewm(chain, "macd_dif", "macd_dea", "0.2::DOUBLE", 9).add(macd_hist="macd_dif - macd_dea")


def add_boll(chain: Chain) -> Chain:
    chain = chain.add(boll_mid=sma("close", 20), _sd=std("close", 20)).add(boll_up="boll_mid + 2.0 * _sd", boll_low="boll_mid - 2.0 * _sd")
    return chain.add(boll_bw=div("boll_up - boll_low", "boll_mid"))


def add_obv(chain: Chain) -> Chain:
    return chain.add(_flow=f"coalesce(volume * sign(close - {lag('close')}), 0)").add(obv=f"sum(_flow) {UPTO}")


def add_dmi(chain: Chain) -> Chain:
    chain = chain.add(_rise=f"coalesce(greatest(high - {lag('high')}, 0), 0)", _fall=f"coalesce(greatest({lag('low')} - low, 0), 0)", _tr14=TR)
    chain = chain.add(_pd="CASE WHEN _rise > _fall THEN _rise ELSE 0 END", _md="CASE WHEN _fall > _rise THEN _fall ELSE 0 END")
    chain = chain.add(_tt=total("_tr14", 14), _pt=total("_pd", 14), _mt=total("_md", 14))
    chain = chain.add(plus_di14=div("100 * _pt", "_tt"), minus_di14=div("100 * _mt", "_tt"))
    return chain.add(_dx=div("100 * abs(plus_di14 - minus_di14)", "(plus_di14 + minus_di14)")).add(adx14=sma("_dx", 14))


def add_cci(chain: Chain) -> Chain:
    chain = chain.add(_tp="(high + low + close) / 3.0").add(_off=f"_tp - ({sma('_tp', 20)})").add(_dev="abs(_off)")
    return chain.add(cci20=div("_off", f"(0.015 * ({sma('_dev', 20)}))"))


def add_kdj(chain: Chain) -> Chain:
    chain = chain.add(_lo=bottom("low", 9), _hi=top("high", 9)).add(_rsv=div("close - _lo", "(_hi - _lo)") + " * 100")
    chain = ewm(ewm(chain, "_rsv", "kdj_k", "(1.0/3)::DOUBLE", 9), "kdj_k", "kdj_d", "(1.0/3)::DOUBLE", 9)
    return chain.add(kdj_j="3 * kdj_k - 2 * kdj_d")


def roc(x: str, n: int) -> str:
    return div(x, f"({lag(x, n)})") + " - 1"


def add_mdd(chain: Chain) -> Chain:
    return chain.add(_dd=div("close", f"({top('close', 60)})") + " - 1").add(mdd60=bottom("_dd", 60))


RANGE = "(high - low)"
CLV = "CASE WHEN high = low THEN 0.0 ELSE greatest(-1.0, least(1.0, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0.0))) END"
WICKS = {
    "upper_wick_ratio": clip("coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0.0)", 0.0, 1.0),
    "lower_wick_ratio": clip("coalesce((least(open, close) - low) / nullif(high - low, 0), 0.0)", 0.0, 1.0),
    "body_ratio": clip("coalesce(abs(close - open) / nullif(high - low, 0), 0.0)", 0.0, 1.0),
}
WR14 = div(f"({top('high', 14)}) - close", f"(({top('high', 14)}) - ({bottom('low', 14)}))") + " * 100"
DIST = {n: div("close", f"({top('close', n)})") + " - 1" for n in (20, 60)}
BREAKOUT = f"(close - CASE WHEN count(high) OVER ({LINE} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN max(high) OVER ({LINE} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END) / (atr14 + 1e-12)"
RVOL = f"volume / (({sma('volume', 20)}) + 1e-12)"
VOLZ = f"(volume - ({sma('volume', 20)})) / (({std('volume', 20)}) + 1e-12)"
GAP = f"abs(open - {lag('close')}) / (atr14 + 1e-12)"
TRPCT = f"({TR}) / (abs({lag('close')}) + 1e-12)"
VPDIV = f"({roc('close', 5)}) - (({sma('volume', 5)}) / (({sma('volume', 20)}) + 1e-12) - 1)"


def panel() -> Chain:
    """The bars with the 38 indicator columns."""
    chain = Chain()
    for n in (20, 50, 200):
        chain = ewm(chain, "close", f"ema{n}", f"(2.0/{n + 1})::DOUBLE", n)
    chain = psar(add_kdj(add_macd(chain)))
    chain = add_atr(add_rsi(chain)).add(atr_pct=div("atr14", "close"))
    chain = add_mdd(add_cci(add_dmi(add_obv(add_boll(chain)))))
    return chain.add(
        roc10=roc("close", 10), roc20=roc("close", 20), roc60=roc("close", 60), wr14=WR14, breakout20_atr=BREAKOUT, dist_high20=DIST[20], dist_high60=DIST[60],
        rvol20=RVOL, vol_z20=VOLZ, gap_atr14=GAP, tr_pct=TRPCT, clv=CLV, **WICKS)
