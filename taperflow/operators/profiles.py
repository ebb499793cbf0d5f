"""Configurations of the routed forecaster, by name."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import log


@dataclass(frozen=True)
class Profile:
    anchor: str = "control"  # control, linear or none
    recovery: bool = True
    cohort: bool = True
    ratios: bool = True
    terminal: bool = True
    # Weights of the candidate forecast against the anchor, by route.
    default_weight: float = 0.0
    depressed_weight: float = 0.0
    streak_weight: float = 0.80
    anchor_better_weight: float = 0.05
    candidate_better_weight: float = 0.65
    thin_weight: float = 0.35
    anchor_better_ratio: float = 0.92
    candidate_better_ratio: float = 0.85
    thin_months: int = 18
    min_wells: int = 5
    full_wells: int = 20
    use_global: bool = True
    need_group: bool = False
    cohort_most: float = 0.65
    blend_space: str = "linear"
    support_months: int = 12
    min_age_support: int = 0
    max_log_mad: float | None = None
    max_history_error: float | None = None
    max_month_divergence: float | None = None
    max_total_divergence: float | None = None
    endpoint: tuple[float, float] | None = None
    endpoint_volatility: float | None = None
    primary_phases: tuple[str, ...] | None = None
    groups: tuple[str, ...] | None = None
    phases: tuple[str, ...] | None = None
    own_ratio_blend: float = 0.93

    @property
    def anchor_alone(self) -> bool:
        """No candidate can get weight: its fits and backtests needn't be planned."""
        weights = (self.default_weight, self.depressed_weight, self.streak_weight, self.anchor_better_weight, self.candidate_better_weight, self.thin_weight)
        return self.anchor != "none" and not self.recovery and not any(weights)


_still = Profile(recovery=False, cohort=False, ratios=False, streak_weight=0.0, anchor_better_weight=0.0, candidate_better_weight=0.0, thin_weight=0.0, use_global=False)
_peers = replace(_still, cohort=True, need_group=True, min_wells=8, full_wells=30)
_router = replace(_peers, recovery=True, streak_weight=0.35, candidate_better_weight=0.40, thin_weight=0.10, anchor_better_ratio=0.95, candidate_better_ratio=0.80)

# Names and settings of the published profiles.
PROFILES: dict[str, Profile] = {
    "scipy_control": replace(_still, terminal=False),
    "anchor_only": _still,
    "candidate_gate": replace(_still, candidate_better_weight=0.40, candidate_better_ratio=0.80),
    "recovery_conservative": replace(_still, recovery=True, streak_weight=0.35),
    "cohort_conservative": _peers,
    "selective_cohort_v1": replace(_peers, terminal=False, need_group=False, primary_phases=("oil",), groups=("dj", "eagle_ford", "delaware"), phases=("oil",)),
    "gated_cohort_v1": replace(_peers, terminal=False, min_wells=12, full_wells=40, cohort_most=0.25, blend_space="log", min_age_support=8, max_log_mad=0.40, max_history_error=0.35, max_month_divergence=log(1.35), max_total_divergence=log(1.18), endpoint=(0.60, 1.60), endpoint_volatility=0.45),
    "major_conservative": _router,
    "full_conservative": replace(_router, ratios=True, own_ratio_blend=0.97),
    "v12_fixed": Profile(),
    "v11_regression": Profile(anchor="linear"),
    "candidates_only": Profile(anchor="none", recovery=False, cohort=False, ratios=False),
}
#: Kept for diagnosis only.
DIAGNOSTIC = ("v11_regression", "candidates_only")


def names(production_only: bool = False) -> tuple[str, ...]:
    return tuple(n for n in PROFILES if not (production_only and n in DIAGNOSTIC))


def profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(PROFILES)}")
    return PROFILES[name]
