"""Tunable thresholds, grouped the way the operators consume them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScoreParams:
    """Priors and tier cut-offs of the insider skill score (fixed default values)."""

    alpha0: float = 5.5
    beta0: float = 4.5
    baseline: float = 0.55
    prior_excess: float = 0.01
    shrinkage_k: float = 5.0
    default_sigma: float = 0.15
    full_credibility_n: int = 8
    sigma_typical: float = 0.15
    w_hit_rate: float = 0.5
    w_magnitude: float = 0.5
    elite_skill: float = 1.5
    elite_confidence: float = 0.80
    elite_n: int = 6
    strong_skill: float = 0.8
    strong_confidence: float = 0.65
    min_n: int = 3
    min_momentum_pairs: int = 5


@dataclass(frozen=True)
class SignalParams:
    """Windows and limits of signals and positions (fixed default values)."""

    cluster_window_days: int = 7
    hold_days: int = 60
    default_role_weight: float = 0.5
    default_median_value: float = 50_000.0
    min_event_value: float = 500.0
    max_event_value: float = 10_000_000_000.0
    max_per_insider_ticker: int = 1
    max_per_ticker: int = 2
    base_size_pct: float = 0.05
    csuite_size_pct: float = 0.05
    vol_target_min_pct: float = 0.03
    vol_target_max_pct: float = 0.20
    mass_disappearance_limit: int = 2


@dataclass(frozen=True)
class ResearchParams:
    """Gates of the strategy comparison (fixed default values)."""

    dsr_pass: float = 0.95
    train_screen_sharpe: float = 0.85
    min_validate_trades: int = 100
    nominee_margin: float = 0.10
    stall_threshold: int = 5
    seeds: int = 20


SCORES = ScoreParams()
SIGNALS = SignalParams()
RESEARCH = ResearchParams()
