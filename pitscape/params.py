"""Frozen parameters. These are fixed values: they define what the operators mean."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # availability
    fallback_days: int = 180
    # universe filter
    share_codes: tuple = (10, 11)
    exchanges: tuple = (1, 2, 3)
    min_price: float = 1.0
    min_cap_millions: float = 10.0
    min_volume: float = 100.0
    # links and as-of filters
    link_types: tuple = ("LC", "LU", "LS")
    link_primary: tuple = ("P", "C")
    max_staleness_months: int = 18
    min_history: int = 1
    # robust scores
    winsor_lower: float = 0.01
    winsor_upper: float = 0.99
    min_peers: int = 20
    min_anchor: int = 100
    score_clip: float = 5.0
    # components
    rnd_depreciation: float = 0.20
    tax_rate: float = 0.25
    # labels and folds
    horizons_years: tuple = (3, 5)
    validation_years: int = 5
    test_windows: tuple = ((2000, 2004), (2005, 2009), (2010, 2014), (2015, 2019))
    ridge_grid: tuple = (0.01, 0.1, 1.0, 10.0)
    rate_prior_rows: float = 20.0
    min_train_rows: int = 500
    min_train_failures: int = 20
    min_validation_failures: int = 5
    # dynamics
    frontier: float = 0.95
    probability_clip: float = 1e-6
    min_cohort: int = 20
    crowding_k: int = 10
    success_k: int = 20
    min_reference: int = 100
    surprise_alpha: float = 10.0
    min_surprise_train: int = 1000
    # survival
    survival_horizon: int = 5
    survival_origin: str = "1900-01-01"
    min_reporting_history: int = 3
    # returns
    return_horizons: tuple = (1, 3, 6, 12)
    primary_return_horizon: int = 6
    min_cross_section: int = 30
    quantiles: int = 5
    min_industry_group: int = 10
    # costs: (name, quoted spread multiplier, fixed slippage bps)
    cost_cases: tuple = (("low", 0.5, 5.0), ("conservative", 1.0, 10.0), ("severe", 1.5, 25.0))
    volume_multiplier: float = 1000.0
    trading_days: float = 21.0
    leg_capital: float = 1_000_000.0
    adv_share: float = 0.10
    cap_share: float = 0.001
    max_weight: float = 0.10
    max_half_spread: float = 0.05
    fallback_spread_bps: float = 50.0
    short_min_cap_millions: float = 25.0
    short_min_adv_millions: float = 0.10
    hard_borrow_cap_millions: float = 100.0
    hard_borrow_adv_millions: float = 0.50
    easy_borrow_bps: float = 300.0
    hard_borrow_bps: float = 700.0
    # archetypes
    archetype_train_end: int = 2004
    archetype_sample: int = 25_000
    archetype_min_size: int = 200
    archetype_min_samples: int = 10
    archetype_radius: float = 0.95
    archetype_clip: float = 8.0
    # monitor gates
    alert_fraction: float = 0.10
    peer_k: int = 20
    evaluation_years: tuple = (2013, 2018)


DEFAULT = Params()
