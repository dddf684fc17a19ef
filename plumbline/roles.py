"""Column roles and threshold presets that parameterise the audits."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Names the columns that play a part in an audit; never changes the data."""

    label: str | None = None
    split: str | None = None
    time: str | None = None
    groups: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    annotators: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    conditions: tuple[str, ...] = ()
    path: str | None = None
    slice_mode: str = "month"
    metadata: dict = field(default_factory=dict, hash=False)

    @property
    def reserved(self) -> set[str]:
        """Label, split and time: never treated as features."""
        return {c for c in (self.label, self.split, self.time) if c}


@dataclass(frozen=True)
class TabularThresholds:
    drift_ks: float = 0.30
    pii_hit_rate: float = 0.01
    label_noise_warn: float = 0.05


@dataclass(frozen=True)
class SeriesThresholds(TabularThresholds):
    time_parse_ok_min: float = 0.98
    dup_timestamp_max: float = 0.01
    irregularity_max: float = 2.0


@dataclass(frozen=True)
class AssetThresholds:
    drift_ks: float = 0.30
    pii_hit_rate: float = 0.01
    hamming: int = 6
    blur: float = 25.0
    min_short_side: int = 224
    label_error_warn: float = 0.02
    leakage_warn: float = 0.001
    exact_dup_warn: float = 0.01
    near_dup_warn: float = 0.02
    metadata_completeness_warn: float = 0.90
    schema_consistency_warn: float = 0.95
    kappa_warn: float = 0.80
    worst_bin_warn: float = 0.03
    outlier_warn: float = 0.05
    representation_low: float = 0.80
    representation_high: float = 1.25
    parity_gap_warn: float = 0.05
    missing_disparity_warn: float = 0.10
    traceability_warn: float = 0.95
    integrity_warn: float = 1.0
    suspicious_warn: float = 0.02
    hhi_warn: float = 0.25


# Threshold presets.
TABULAR_PRESETS = {
    "balanced": TabularThresholds(),
    "strict": TabularThresholds(0.20, 0.005, 0.02),
    "lenient": TabularThresholds(0.40, 0.02, 0.10),
}
SERIES_PRESETS = {
    "balanced": SeriesThresholds(),
    "strict": SeriesThresholds(0.20, 0.005, 0.02, 0.995, 0.005, 1.5),
    "lenient": SeriesThresholds(0.40, 0.02, 0.10, 0.95, 0.02, 3.0),
}
ASSET_PRESETS = {
    "balanced": AssetThresholds(),
    "strict": AssetThresholds(
        drift_ks=0.20, pii_hit_rate=0.005, hamming=4, blur=35.0, min_short_side=256,
        label_error_warn=0.01, leakage_warn=0.0, exact_dup_warn=0.005, near_dup_warn=0.01,
        metadata_completeness_warn=0.95, schema_consistency_warn=0.98, kappa_warn=0.85,
        worst_bin_warn=0.05, outlier_warn=0.03, representation_low=0.85, representation_high=1.18,
        parity_gap_warn=0.03, missing_disparity_warn=0.05, traceability_warn=0.98,
        integrity_warn=1.0, suspicious_warn=0.01, hhi_warn=0.20),
    "lenient": AssetThresholds(
        drift_ks=0.40, pii_hit_rate=0.02, hamming=8, blur=18.0, min_short_side=160,
        label_error_warn=0.05, leakage_warn=0.005, exact_dup_warn=0.02, near_dup_warn=0.05,
        metadata_completeness_warn=0.80, schema_consistency_warn=0.90, kappa_warn=0.70,
        worst_bin_warn=0.02, outlier_warn=0.08, representation_low=0.70, representation_high=1.40,
        parity_gap_warn=0.10, missing_disparity_warn=0.15, traceability_warn=0.90,
        integrity_warn=0.99, suspicious_warn=0.05, hhi_warn=0.35),
}
