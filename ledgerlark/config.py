"""Parameters of every stage, validated on the driver.

The numbers below are fixed default values of the behaviour being provided.
"""

from __future__ import annotations

from dataclasses import dataclass

KEYS = ("account_id", "service", "region")

CANONICAL_FIELDS = (
    "event_id", "timestamp", "provider", "account_id", "service", "region",
    "cost_amount", "usage_amount", "usage_unit", "tags", "source_type",
)
REQUIRED_FIELDS = tuple(f for f in CANONICAL_FIELDS if f != "tags")

SEVERITIES = ("none", "low", "medium", "high")
STATUSES = ("open", "acknowledged", "resolved", "suppressed")
ALERT_STATUSES = ("pending", "sent", "failed", "suppressed")
PROVIDERS = ("gcp", "aws", "azure")
TRAINING_SOURCES = {"training_generated": "generated", "training_uploaded": "uploaded"}


def _unit_interval(name: str, value: float) -> None:
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must be in [0, 1], got {value}")


@dataclass(frozen=True)
class RollingConfig:
    target: str = "total_cost"
    windows: tuple[int, ...] = (5, 15, 60)
    aggs: tuple[str, ...] = ("mean", "std", "min", "max", "sum")

    def __post_init__(self):
        unknown = set(self.aggs) - {"mean", "std", "min", "max", "sum"}
        if unknown:
            raise ValueError(f"unsupported aggregates: {sorted(unknown)}")
        if any(w < 1 for w in self.windows):
            raise ValueError("windows must be positive")


@dataclass(frozen=True)
class GrowthConfig:
    target: str = "total_cost"
    lags: tuple[int, ...] = (1, 5, 15)
    windows: tuple[int, ...] = (5, 15, 60)
    periods_per_year: int = 525_600
    pct_cap: float = 5.0
    annual_cap: float = 10.0
    floor: float = 1e-9


@dataclass(frozen=True)
class VolatilityConfig:
    target: str = "total_cost"
    windows: tuple[int, ...] = (5, 15, 60)
    min_periods: int = 2
    periods_per_year: int = 525_600


@dataclass(frozen=True)
class CalendarConfig:
    bucket: str = "bucket"
    tz: str = "UTC"
    business_start: int = 9
    business_end: int = 17


@dataclass(frozen=True)
class BaselineConfig:
    target: str = "total_cost"
    alpha: float = 0.3
    seasonal_weight: float = 0.6
    min_train_rows: int = 60
    min_std: float = 1e-6
    levels: tuple[float, ...] = (0.95,)

    def __post_init__(self):
        if not 0.0 < self.alpha <= 1.0:
            raise ValueError("alpha must be in (0, 1]")
        _unit_interval("seasonal_weight", self.seasonal_weight)
        for level in self.levels:
            if not 0.0 < level < 1.0:
                raise ValueError(f"confidence level must be in (0, 1), got {level}")


@dataclass(frozen=True)
class ResidualConfig:
    target: str = "total_cost"
    levels: tuple[int, ...] = (95,)
    z_cap: float | None = 10.0
    min_std: float = 1e-9


@dataclass(frozen=True)
class RuleConfig:
    target: str = "total_cost"
    budget_limit: float = 1000.0
    jump_pct: float = 0.5
    jump_lookback: int = 15
    sustained_window: int = 3
    sustained_min_growth: float = 0.05
    weight_threshold: float = 0.5
    weight_jump: float = 0.3
    weight_sustained: float = 0.2

    def __post_init__(self):
        weights = (self.weight_threshold, self.weight_jump, self.weight_sustained)
        for w in weights:
            _unit_interval("rule weight", w)
        if abs(sum(weights) - 1.0) > 0.001:
            raise ValueError(f"rule weights must sum to 1, got {sum(weights):.4f}")
        if self.sustained_window < 0 or self.jump_lookback < 1:
            raise ValueError("rule windows must be positive")


@dataclass(frozen=True)
class ScoringConfig:
    weight_ts: float = 0.35
    weight_if: float = 0.40
    weight_rules: float = 0.25
    threshold: float = 0.55
    z_cap: float = 10.0
    enable_ts: bool = True
    enable_if: bool = True
    enable_rules: bool = True

    def weights(self) -> dict[str, float]:
        """Configured weight per signal; a disabled signal weighs nothing."""
        return {
            "ts_signal": self.weight_ts if self.enable_ts else 0.0,
            "if_score": self.weight_if if self.enable_if else 0.0,
            "rule_score": self.weight_rules if self.enable_rules else 0.0,
        }


@dataclass(frozen=True)
class SeverityConfig:
    threshold: float = 0.55
    medium: float = 0.65
    high: float = 0.80

    def __post_init__(self):
        if not 0.0 <= self.threshold < self.medium:
            raise ValueError("threshold must be below the medium boundary")
        if not self.medium < self.high <= 1.0:
            raise ValueError("medium boundary must be below the high boundary (at most 1)")


@dataclass(frozen=True)
class ReclassifyConfig:
    """Stored-anomaly thresholds; ``low`` is kept for reference only."""

    low: float = 0.20
    medium: float = 0.50
    high: float = 0.80


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 100
    max_samples: int = 256
    contamination: float | str = "auto"
    seed: int = 42
    min_train_rows: int = 60


@dataclass(frozen=True)
class ReconstructionConfig:
    hidden_dim: int = 0
    threshold: float = 0.6
    pct_lo: float = 0.05
    pct_hi: float = 0.95
    min_train_rows: int = 60

    def width(self, n_features: int) -> int:
        return self.hidden_dim or max(2, n_features // 3)


@dataclass(frozen=True)
class CalibrationConfig:
    grid: tuple[float, ...] = (
        0.30, 0.35, 0.40, 0.42, 0.45, 0.48, 0.50, 0.52, 0.55,
        0.58, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90,
    )
    metric: str = "f1"
    min_recall: float = 0.20
    min_precision: float = 0.10
    expected_rate: float = 0.05

    def __post_init__(self):
        if any(not 0.0 < t < 1.0 for t in self.grid):
            raise ValueError("thresholds must be in (0, 1)")
        if self.metric not in ("f1", "precision", "recall"):
            raise ValueError(f"unknown target metric: {self.metric}")
        if not 0.0 < self.expected_rate < 0.5:
            raise ValueError("expected_rate must be in (0, 0.5)")


@dataclass(frozen=True)
class TunerConfig:
    contamination_grid: tuple[float, ...] = (0.01, 0.02, 0.03, 0.05, 0.08, 0.10, 0.15, 0.20)
    threshold_grid: tuple[float, ...] = (
        0.30, 0.35, 0.40, 0.42, 0.45, 0.48, 0.50, 0.52, 0.55,
        0.58, 0.60, 0.65, 0.70, 0.75, 0.80,
    )
    metric: str = "f1"
    min_recall: float = 0.20
    min_precision: float = 0.10
    expected_rate: float = 0.05
    default_threshold: float = 0.55


FP_CURVE_GRID = (
    0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40,
    0.45, 0.50, 0.55, 0.60, 0.70, 0.80,
)
SENSITIVITY_GRID = (0.30, 0.40, 0.45, 0.50, 0.55, 0.60, 0.70, 0.80)
SIGNAL_COLUMNS = ("ts_signal", "if_score", "rule_score", "anomaly_score")


@dataclass(frozen=True)
class AlertConfig:
    channels: tuple[str, ...] = ("in_app", "email")
    cooldown_seconds: int = 3600
    error_length: int = 512


@dataclass(frozen=True)
class IngestLimits:
    max_tags: int = 50
    max_key: int = 64
    max_value: int = 256
    future_skew_seconds: int = 300
    decimal_places: int = 6
    sources: tuple[str, ...] = ("synthetic", "live")


@dataclass(frozen=True)
class InjectionConfig:
    """Backtest injection; ``None`` disables an injector."""

    seed: str = "backtest"
    spike_count: int | None = 5
    spike_multiplier: float = 6.0
    drift_start: int | None = None
    drift_slope: float = 0.0
    shift_start: int | None = None
    shift_amount: float = 0.0
    budget_start: int | None = None
    budget_duration: int = 1
    budget_multiplier: float = 1.1
    budget: float | None = None
