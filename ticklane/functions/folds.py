"""Figures of a group's rows (a code's days in order, or a day's codes) as numpy arrays, for folds in Arrow batches; a null is NaN.

Sums start with the oldest row, as in Spark's windows, so both give the same doubles.  A figure of n rows is null unless all are there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

EPS = 1e-12


def values(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).cast(pa.float64()).to_numpy()


def without_nans(rows: pa.Table) -> pa.Table:
    """rows with null for NaN: a NaN is no value."""
    for k, kind in enumerate(rows.schema.types):
        if pa.types.is_floating(kind) and pc.any(pc.is_nan(rows.column(k))).as_py():
            rows = rows.set_column(k, rows.schema.field(k), pc.if_else(pc.is_nan(rows.column(k)), pa.scalar(None, kind), rows.column(k)))
    return rows


def with_figures(rows: pa.Table, made: dict[str, np.ndarray]) -> pa.Table:
    for name, x in made.items():
        rows = rows.append_column(name, x if isinstance(x, pa.Array) else pa.array(np.asarray(x, dtype=float), from_pandas=True))
    return rows


def div(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(y == 0, np.nan, x / y)


def clip(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.where(x < low, low, np.where(x > high, high, x))


def near(x: np.ndarray) -> np.ndarray:
    return np.rint(x * 1e9) / 1e9


def lag(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(len(x) - n, 0)]])


def _behind(n: int, made: np.ndarray, rows: int) -> np.ndarray:
    return np.concatenate([np.full(min(n - 1, rows), np.nan), made])


def total(x: np.ndarray, n: int) -> np.ndarray:
    made = np.zeros(max(len(x) - n + 1, 0))
    for k in range(n):
        made += x[k : k + len(made)]
    return _behind(n, made, len(x))


def mean(x: np.ndarray, n: int) -> np.ndarray:
    return total(x, n) / n


def deviation(x: np.ndarray, n: int) -> np.ndarray:
    """Sample standard deviation, by the same running moments as Spark's."""
    average, m2 = np.zeros(max(len(x) - n + 1, 0)), np.zeros(max(len(x) - n + 1, 0))
    for k in range(n):
        delta = x[k : k + len(m2)] - average
        step = delta / (k + 1.0)
        average += step
        m2 += delta * (delta - step)
    return _behind(n, np.sqrt(m2 / (n - 1.0)), len(x))


def _views(x: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, n) if len(x) >= n else np.empty((0, n))


def highest(x: np.ndarray, n: int) -> np.ndarray:
    return _behind(n, _views(x, n).max(axis=1), len(x))


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    return _behind(n, _views(x, n).min(axis=1), len(x))


def place(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    """Average-rank percentile of the last value among the window's values; nulls are skipped, fewer than least are null."""
    seen = _views(np.concatenate([np.full(n - 1, np.nan), x]), n)
    last = x[:, None]
    lower, same, there = (seen < last).sum(axis=1), (seen == last).sum(axis=1), (seen == seen).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((there >= (least or n)) & (x == x), (lower + same / 2.0 + 0.5) / there, np.nan)


def share(x: np.ndarray, n: int) -> np.ndarray:
    """Share of the window's values that are <= the last one."""
    seen = _views(x, n)
    return _behind(n, np.where(np.isnan(seen).any(axis=1), np.nan, (seen <= x[n - 1 :, None]).sum(axis=1) / float(n)), len(x))


def rank_of_all(x: np.ndarray) -> np.ndarray:
    """Percentile rank among all values: average of ties, null stays null."""
    there = np.flatnonzero(x == x)
    order = there[np.argsort(x[there], kind="stable")]
    ordered = x[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, int)
    ties = np.diff(np.append(first, len(order)))
    out = np.full(len(x), np.nan)
    out[order] = np.repeat((first + 1 + (ties - 1) / 2.0) / max(len(order), 1), ties)
    return out


def ewm(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """pandas' ewm(alpha, adjust=False, min_periods=least).mean() to the last bit: for the short columns of a code setting that up takes
    longer than the sums."""
    alpha = 1.0 / (1.0 + (1.0 - alpha) / alpha)
    keep, held, weight, seen, out = 1.0 - alpha, None, 1.0, 0, []
    for v in x.tolist():
        there = v == v
        if held is None:
            held = v if there else None
        else:
            weight *= keep
            if there:
                if held != v:
                    held = (weight * held + alpha * v) / (weight + alpha)
                weight = 1.0
        seen += there
        out.append(held if held is not None and seen >= least else np.nan)
    return np.array(out, dtype=float)


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return ewm(x, 2.0 / (n + 1), n)


def true_range(high: np.ndarray, low: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(before - low))


def bands(close: np.ndarray, n: int = 20) -> dict[str, np.ndarray]:
    middle, off = mean(close, n), 2.0 * deviation(close, n)
    return {"boll_mid": middle, "boll_up": middle + off, "boll_low": middle - off, "boll_bw": div((middle + off) - (middle - off), middle)}


def directions(high: np.ndarray, low: np.ndarray, tr: np.ndarray, n: int = 14) -> dict[str, np.ndarray]:
    rise, fall = np.fmax(high - lag(high), 0.0), np.fmax(lag(low) - low, 0.0)
    whole = total(tr, n)
    plus, minus = div(100 * total(np.where(rise > fall, rise, 0.0), n), whole), div(100 * total(np.where(fall > rise, fall, 0.0), n), whole)
    return {"plus_di14": plus, "minus_di14": minus, "adx14": mean(div(100 * np.abs(plus - minus), plus + minus), n)}


def strength(close: np.ndarray, n: int = 14) -> np.ndarray:
    step = np.nan_to_num(close - lag(close))
    return clip(100 - div(np.float64(100), 1 + div(mean(np.fmax(step, 0.0), n), mean(np.fmax(-step, 0.0), n))), 0.0, 100.0)


def balance(close: np.ndarray, volume: np.ndarray) -> np.ndarray:
    return np.cumsum(np.nan_to_num(volume * np.sign(close - lag(close))))


def channel(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 20) -> np.ndarray:
    price = (high + low + close) / 3.0
    off = price - mean(price, n)
    return div(off, 0.015 * mean(np.abs(off), n))
