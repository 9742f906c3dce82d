"""Constants of the scoring rules."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Risk of merchant category codes.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}
MCC_DEFAULT = 0.5

#: Fixed-point scale of a feature, and the value that stands for "no last transaction".
SCALE = 10_000
MISSING = -10_000
DIMENSIONS = 14


@dataclass(frozen=True)
class Normalization:
    """What each raw feature is divided by."""

    max_amount: float = 10000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10000.0


@dataclass(frozen=True)
class Scoring:
    """Neighbours asked, frauds from which a transaction is denied, clusters probed first."""

    k: int = 5
    deny_from: int = 3
    probes: int = 12
    max_clusters: int = 2048
    iterations: int = 20
    max_refs: int = 3_500_000
    normalization: Normalization = field(default_factory=Normalization)


DEFAULT = Scoring()
