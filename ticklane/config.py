"""Settings of the rule signals, scores and portfolios: frozen values with a two-level merge."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class IndexGate:
    adx_trend_th: float = 25.0
    adx_range_th: float = 20.0
    bw_low_quantile: float = 0.3
    bw_window: int = 120


@dataclass(frozen=True)
class StockState:
    adx_trend_th: float = 25.0
    adx_range_th: float = 20.0


@dataclass(frozen=True)
class S1:
    atr_mul: float = 1.8
    atr_mul_pullback: float = 0.8
    rsi_bull_low: float = 45.0
    obv_confirm: bool = True
    obv_lookback: int = 20


@dataclass(frozen=True)
class S2:
    bw_quantile: float = 0.3
    bw_quantile_window: int = 120
    atr_stop_mul: float = 1.0
    obv_confirm: bool = True


@dataclass(frozen=True)
class S3:
    rsi_buy: float = 35.0
    atr_n: float = 1.0
    atr_stop_mul: float = 1.2


@dataclass(frozen=True)
class S4:
    cci_th: float = 100.0


@dataclass(frozen=True)
class Risk:
    per_trade_risk_pct: float = 0.005
    max_pos_per_stock: float = 0.2


@dataclass(frozen=True)
class Valuation:
    enabled: bool = False
    mode: str = "rank_only"
    expensive_cut: float = 0.8
    pb_weight: float = 0.5
    ps_weight: float = 0.5
    tech_weight: float = 0.7
    value_weight: float = 0.3
    ml_weight: float = 0.0
    rolling_window: int = 120


@dataclass(frozen=True)
class Portfolio:
    top_n: int = 3
    strategy_profile: str = "blended"
    min_score: float = 55.0
    min_hold_days: int = 7
    max_hold_days: int = 20
    exit_rank_mult: float = 4.0
    turnover_buffer: float = 6.0
    min_total_exposure: float = 0.15
    base_total_exposure: float = 0.45
    max_total_exposure: float = 0.70
    min_position_weight: float = 0.10
    max_position_weight: float = 0.35
    exit_style: str = "rank"
    exit_score_floor: float | None = None
    exit_score_drop: float = 10.0
    signal_exit_score_floor: float | None = None
    trail_min_open_profit: float = 0.10
    trail_giveback_pct: float = 0.06
    trail_atr_buffer: float = 1.2

    @property
    def floor(self) -> float:
        return self.min_score - 2.0 if self.exit_score_floor is None else self.exit_score_floor

    @property
    def signal_floor(self) -> float:
        return self.floor + 2.0 if self.signal_exit_score_floor is None else self.signal_exit_score_floor


@dataclass(frozen=True)
class Config:
    index_gate: IndexGate = field(default_factory=IndexGate)
    stock_state: StockState = field(default_factory=StockState)
    s1: S1 = field(default_factory=S1)
    s2: S2 = field(default_factory=S2)
    s3: S3 = field(default_factory=S3)
    s4: S4 = field(default_factory=S4)
    risk: Risk = field(default_factory=Risk)
    valuation: Valuation = field(default_factory=Valuation)
    portfolio: Portfolio = field(default_factory=Portfolio)
    cost_bp: float = 2.0

    def merged(self, over: dict) -> Config:
        """Settings replaced by those of a two-level mapping; names that do not exist raise."""
        known = {f.name for f in fields(self)}
        if unknown := set(over) - known:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: replace(getattr(self, k), **v) if isinstance(v, dict) else v for k, v in over.items()})

    @staticmethod
    def load(path: str) -> Config:
        """A JSON file of overrides."""
        with open(path, encoding="utf-8") as f:
            return Config().merged(json.load(f))

    def dump(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=1)


DEFAULT = Config()

FACTORS = ("trend", "momentum", "medium_term", "signal", "quality", "value_factor", "risk", "liquidity")
# Factor weights of the composite and of each profile, in the order of FACTORS.
COMPOSITE = (0.24, 0.16, 0.20, 0.14, 0.12, 0.08, 0.04, 0.02)
PROFILES = {
    "blended": (0.24, 0.16, 0.20, 0.14, 0.12, 0.08, 0.04, 0.02),
    "breakout": (0.22, 0.10, 0.28, 0.20, 0.12, 0.02, 0.03, 0.03),
    "pullback": (0.28, 0.06, 0.12, 0.22, 0.12, 0.10, 0.07, 0.03),
    "mid_momo": (0.18, 0.18, 0.30, 0.10, 0.12, 0.04, 0.05, 0.03),
    "quality_trend": (0.26, 0.08, 0.20, 0.10, 0.22, 0.06, 0.05, 0.03),
    "value_trend": (0.22, 0.06, 0.18, 0.10, 0.10, 0.24, 0.07, 0.03),
    "pullback_quality_combo": (0.27, 0.07, 0.16, 0.16, 0.18, 0.08, 0.05, 0.03),
}


def _variant(profile: str, min_score: float = 58, hold: tuple[int, int] = (7, 20), mult: float = 4.0, buffer: float = 6, exposure: tuple[float, float] = (0.40, 0.60), weight: float = 0.26, **more) -> Portfolio:
    return Portfolio(
        strategy_profile=profile, min_score=min_score, min_hold_days=hold[0], max_hold_days=hold[1], exit_rank_mult=mult, turnover_buffer=buffer,
        base_total_exposure=exposure[0], max_total_exposure=exposure[1], max_position_weight=weight, **more)


def _pullback_hold(days: int, least: int, mult: float, buffer: float, floors: tuple[float, float, float]) -> Portfolio:
    return _variant("pullback", hold=(least, days), mult=mult, buffer=buffer, exit_score_floor=floors[0], exit_score_drop=floors[1], signal_exit_score_floor=floors[2])


# The variants that walk-forward runs compare.
VARIANTS = {
    "blended": _variant("blended", 58, (7, 20), 4.5, 6, (0.45, 0.65), 0.28),
    "blended_longhold": _variant("blended", 58, (15, 9999), 8, 16),
    "breakout": _variant("breakout", 60, (7, 18), 5, 6, (0.40, 0.60), 0.30),
    "pullback": _variant("pullback", 58, (10, 24), 5, 8),
    "pullback_hold15": _pullback_hold(15, 7, 5.5, 9, (61, 11, 64)),
    "pullback_hold20": _pullback_hold(20, 10, 6, 10, (60, 12, 63)),
    "pullback_hold30": _pullback_hold(30, 10, 7, 12, (59, 13, 62)),
    "pullback_hold45": _pullback_hold(45, 15, 8, 15, (58, 15, 61)),
    "pullback_longhold": _variant("pullback", 58, (15, 9999), 9, 18),
    "mid_momo": _variant("mid_momo", 58, (7, 20), 5, 7, (0.45, 0.65), 0.28),
    "quality_trend": _variant("quality_trend", 58, (10, 24), 5.5, 8, (0.45, 0.65), 0.26),
    "quality_trend_longhold": _variant("quality_trend", 58, (15, 9999), 8, 16, (0.40, 0.60), 0.24),
    "value_trend": _variant("value_trend", 56, (10, 24), 5, 7, (0.35, 0.55), 0.24),
}
_COMBO = _variant("pullback_quality_combo", 58, (15, 9999), 8.5, 17, weight=0.25)
_NO_TRAIL = {"trail_min_open_profit": 1.0, "trail_giveback_pct": 1.0, "trail_atr_buffer": 99.0}


def _exit_by(style: str, mult: float, buffer: float, floors: tuple[float, float, float], **more) -> Portfolio:
    return replace(_pullback_hold(45, 15, mult, buffer, floors), exit_style=style, **more)


_LONG = {"pullback_longhold": VARIANTS["pullback_longhold"], "quality_trend_longhold": VARIANTS["quality_trend_longhold"], "pullback_quality_combo": _COMBO}
# The sets of variants that are compared, each in its order (of equal scores the first is picked).
VARIANT_SETS = {
    "full": VARIANTS,
    "combo_compare": _LONG,
    "meta_compare": _LONG | {"meta_switch_rsi_vol": replace(_COMBO, strategy_profile="meta_switch_rsi_vol")},
    "regime_compare": _LONG | {"regime_switch": replace(_COMBO, strategy_profile="regime_switch")},
    "pullback_compare": {k: VARIANTS[k] for k in ("pullback_hold15", "pullback_hold30", "pullback_hold45")},
    "pullback_exit_compare": {
        "pullback_rank_exit": _exit_by("rank", 8, 15, (58, 15, 61)),
        "pullback_score_exit": _exit_by("score", 10, 20, (61, 10, 64)),
        "pullback_trend_exit": _exit_by("trend", 12, 24, (59, 12, 63)),
    },
    "pullback_opt_compare": {
        "pullback_rank_exit": _exit_by("rank", 8, 15, (58, 15, 61), **_NO_TRAIL),
        "pullback_rank_trail": _exit_by("rank", 8.5, 16, (57, 16, 60), trail_min_open_profit=0.10, trail_giveback_pct=0.06, trail_atr_buffer=1.1),
    },
}
# The settings of a daily run's portfolio by profile; others than pullback share one row.
DAILY = {"pullback": VARIANTS["pullback_longhold"]}
DAILY |= {p: replace(_COMBO, strategy_profile=p) for p in ("quality_trend", "pullback_quality_combo")}
# The valuation variants that tuned rule settings are tested with.
VALUATION_VARIANTS = {
    "baseline": {"enabled": False, "mode": "rank_only", "ml_weight": 0.0},
    "value_pb": {"enabled": True, "mode": "rank_only", "pb_weight": 1.0, "ps_weight": 0.0},
    "value_ps": {"enabled": True, "mode": "rank_only", "pb_weight": 0.0, "ps_weight": 1.0},
    "value_pbps": {"enabled": True, "mode": "rank_only", "pb_weight": 0.5, "ps_weight": 0.5},
    "value_soft_filter": {"enabled": True, "mode": "soft_filter", "pb_weight": 0.5, "ps_weight": 0.5},
    "value_ml_combo": {"enabled": True, "mode": "rank_only", "pb_weight": 0.5, "ps_weight": 0.5, "ml_weight": 0.2, "tech_weight": 0.6, "value_weight": 0.2},
}
