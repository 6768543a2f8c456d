"""Thresholds and weights, passed to operators as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field

CRORE = 1.0e7


@dataclass(frozen=True)
class SignalThresholds:
    pullback_max_distance_pct: float = 3.0
    pullback_rsi_low: float = 40.0
    pullback_rsi_high: float = 50.0
    momentum_rsi_floor: float = 60.0
    breakout_volume_multiple: float = 2.0
    darvas_days: int = 20
    darvas_max_range_pct: float = 10.0
    oversold_rsi: float = 30.0
    atr_stop_multiple: float = 2.0
    target_r_multiple: float = 2.5


@dataclass(frozen=True)
class StrategyThresholds:
    min_history_rows: int = 220
    breakout_min_rows: int = 140
    breakout_volume_multiple: float = 2.0
    breakout_max_extension_pct: float = 6.0
    high_breakout_volume_floor: float = 1.2
    high_breakout_max_extension_pct: float = 4.0
    liquidity_pass_cr: float = 5.0
    liquidity_warn_cr: float = 3.0
    stale_price_days: int = 5
    min_price: float = 20.0
    high_atr_pct: float = 8.0
    extreme_atr_pct: float = 12.0


@dataclass(frozen=True)
class QualityThresholds:
    max_missing_close_pct: float = 5.0
    max_single_day_move_pct: float = 40.0
    stale_price_days: int = 5


@dataclass(frozen=True)
class ScoreWeights:
    fundamentals: float = 0.35
    technicals: float = 0.30
    flows: float = 0.17
    events_quality: float = 0.12
    macro_sector: float = 0.06
    strong: float = 80.0
    watchlist: float = 60.0
    neutral: float = 40.0

    def normalised(self) -> dict[str, float]:
        raw = {
            name: getattr(self, name)
            for name in ("fundamentals", "technicals", "flows", "events_quality", "macro_sector")
        }
        total = sum(raw.values())
        return {name: value / total for name, value in raw.items()} if total else raw


@dataclass(frozen=True)
class Config:
    signals: SignalThresholds = field(default_factory=SignalThresholds)
    strategies: StrategyThresholds = field(default_factory=StrategyThresholds)
    quality: QualityThresholds = field(default_factory=QualityThresholds)
    weights: ScoreWeights = field(default_factory=ScoreWeights)


DEFAULT = Config()
