"""Parameters of the decision models."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LabelConfig:
    baseline_days: int = 60
    outcome_days: int = 60
    weight_price: float = 0.5
    weight_velocity: float = 0.3
    weight_interest: float = 0.2
    band_low: float = 0.4
    band_high: float = 2.5
    min_peers: int = 3
    z_threshold: float = 2.0
    min_edge: float = 0.15
    min_spread: float = 0.05
    min_sales: int = 2
    min_weeks: int = 4
    grid_day: int = 1


@dataclass(frozen=True)
class PricingConfig:
    window_days: int = 60
    min_comps: int = 3
    fade_score: float = 0.5
    max_hold_days: int = 120
    reference_grade: int = 5
    grade_step: float = 0.08
    floor: float = 0.4


@dataclass(frozen=True)
class BacktestConfig:
    k: int = 5
    min_score: float = 0.5
    fee_rate: float = 0.12
    hold_cost_per_day: float = 0.0
    pricing: PricingConfig = PricingConfig()
