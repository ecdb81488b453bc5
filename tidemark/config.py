"""Rules of an analysis as frozen objects, whose values become literals in plans."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Phases with their first and last day: offsets from the onset ("s") or from the end ("e") of the event.
PHASES = {"anticipatory": ("s", -7, "s", -1), "immediate": ("s", 0, "e", 2), "early": ("e", 3, "e", 7), "extended": ("e", 8, "e", 28)}


@dataclass(frozen=True)
class Rules:
    """Thresholds of the series operators; the defaults are the full-length ones."""

    days_before: int = 28
    days_after: int = 28
    least_request_days: int = 60
    phases: dict = field(default_factory=lambda: dict(PHASES))
    least_baseline_days: int = 14
    least_post_days: int = 7
    least_sd: float = 0.001
    low_volume_share: float = 0.5
    stable_correlation: float = 0.8
    stable_date_range: int = 3
    stable_phase_sd: float = 1.0
    least_correlation_days: int = 14
    phase_coverage: float = 0.8
    most_zero_share: float = 0.5
    signal_lift: float = 1.0
    signal_robust: float = 1.0
    least_adjusted: float = 1.0
    least_controls: int = 2
    strong_days: int = 2
    moderate_days: int = 7
    national_days: int = 2
    support_share: float = 0.5


#: The same rules in short windows, for tables of one month.
SHORT = Rules(
    days_before=14, days_after=9, least_request_days=24,
    phases={"anticipatory": ("s", -3, "s", -1), "immediate": ("s", 0, "e", 0), "early": ("e", 2, "e", 4), "extended": ("e", 5, "e", 9)},
    least_baseline_days=5, least_post_days=3, least_correlation_days=5,
)
