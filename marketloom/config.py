"""Thresholds of the operators. Fixed values where results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

ALL = "ALL"


@dataclass(frozen=True)
class Quality:
    min_area: float = 20.0
    max_area: float = 400.0
    lease_term: int = 99
    min_lease_year: int = 1960
    lease_tolerance: float = 2.0
    outlier_z: float = 5.0
    outlier_group: int = 30


@dataclass(frozen=True)
class Market:
    kpi_months: int = 3
    min_sales: int = 5


@dataclass(frozen=True)
class Forecast:
    horizon: int = 6
    min_history: int = 36
    min_recent: int = 60
    max_thin: int = 2
    folds: int = 6
    step: int = 3
    min_cell: int = 30


@dataclass(frozen=True)
class Comparables:
    months: int = 24
    top: int = 5
    area: float = 10.0
    storey: float = 6.0
    lease: float = 8.0
    recency: float = 12.0
    metres: float = 600.0


@dataclass(frozen=True)
class Loan:
    """Loan terms; ``tiers`` are (band width, marginal duty rate), the last band is open."""

    loan_to_value: float = 0.75
    annual_rate: float = 0.026
    years: int = 25
    repayment_limit: float = 0.30
    comfortable: float = 0.25
    tiers: tuple = ((180_000.0, 0.01), (180_000.0, 0.02), (640_000.0, 0.03), (500_000.0, 0.04), (1_500_000.0, 0.05), (None, 0.06))

    def __post_init__(self):
        if not 0 < self.loan_to_value <= 0.9 or not 0 <= self.annual_rate <= 0.1 or not 1 <= self.years <= 35 or not 0 < self.repayment_limit <= 1:
            raise ValueError("loan terms out of range")


@dataclass(frozen=True)
class Walk:
    metres_per_minute: float = 80.0
    detour: float = 1.3
    bus_radius: float = 400.0
    school_radius: float = 1000.0
    city: tuple = (1.2840, 103.8514)
