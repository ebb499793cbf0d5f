"""Promotion gates: one evaluator over a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: gate set -> {rule: (measure, comparison, limit)}; measures are columns of the evidence row.
# The published limits.
RULES = {
    "selection": {"no_mismatch": ("mismatches", "<=", 0), "no_failures": ("failures", "<=", 0), "better": ("delta", "<", 0), "interval": ("ci_high", "<", 0), "relative": ("relative", "<=", -0.02), "catastrophic": ("catastrophic_delta", "<=", 0.01), "segments": ("worst_segment_10", "<=", 0.05)},
    "confirmation": {"wells": ("wells", ">=", 30), "no_failures": ("failures", "<=", 0), "better": ("delta", "<", 0), "interval": ("ci_high", "<", 0), "relative": ("relative", "<=", -0.02), "catastrophic": ("catastrophic_delta", "<=", 0.01), "cumulative": ("cumulative_delta", "<=", 0.02), "segments": ("worst_segment_10", "<=", 0.05)},
    "strict": {"no_mismatch": ("mismatches", "<=", 0), "wells": ("wells", ">=", 100), "no_failures": ("failures", "<=", 0), "relative": ("relative", "<=", -0.01), "probability": ("p_better", ">=", 0.95), "catastrophic": ("catastrophic_delta", "<=", 0.005), "p95": ("p95_delta", "<=", 0.02), "cumulative": ("cumulative_delta", "<=", 0.01), "segments": ("worst_segment_20", "<=", 0.03), "runtime": ("runtime_ratio", "<=", 2.5)},
    "seeds": {"better": ("delta", "<", 0), "win_rate": ("win_rate", ">=", 0.70), "clean": ("clean_relative", "<=", 0.05), "worst": ("worst_scenario", "<=", 0.25)},
    "classifier": {"precision": ("precision", ">=", 0.90), "clean_fpr": ("clean_fpr", "<=", 0.05)},
}


def evaluate(evidence: DataFrame, rules: str) -> DataFrame:
    """gate, value, passed per rule: a missing measure fails.  evidence: one row."""
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    have = set(evidence.columns)
    rows = [F.struct(F.lit(g).alias("gate"), (F.col(m).cast("double") if m in have else F.lit(None).cast("double")).alias("value"), F.coalesce(ops[op](F.col(m), F.lit(lim)) if m in have else F.lit(False), F.lit(False)).alias("passed")) for g, (m, op, lim) in RULES[rules].items()]
    return evidence.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def promote(evidence: DataFrame, rules: str, challenger: str, base: str = "scipy_control") -> DataFrame:
    """promoted, recommendation: the challenger if every gate passes, else the base."""
    x = evaluate(evidence, rules).agg(F.bool_and("passed").alias("promoted"))
    return x.select("promoted", F.when(F.col("promoted"), challenger).otherwise(base).alias("recommendation"))


def require_reported(manifest: dict) -> None:
    """Refuses a board whose hold-out isn't wholly of reported months."""
    gate = manifest.get("provenance_gate") or {}
    if gate.get("mode") not in ("reported_holdout", "reported_full"):
        raise ValueError("the board must be made with provenance mode reported_holdout or reported_full")
    if float(gate.get("min_holdout_reported_fraction") or 0.0) < 1.0:
        raise ValueError("the board doesn't guarantee a wholly reported hold-out")


def require_consent(role: str, given: bool, locked: tuple[str, ...] = ("eval",)) -> dict | None:
    """Refuses a locked role without consent; with it, the receipt to be kept beside the report."""
    if role not in locked:
        return None
    if not given:
        raise PermissionError(f"role {role!r} is locked: its evaluation needs explicit consent")
    return {"role": role, "locked": True, "consent": True}


def select_profile(scores: DataFrame) -> DataFrame:
    """profile of least score, then least complexity.  scores: profile, score, complexity."""
    return scores.agg(F.min_by("profile", F.struct("score", "complexity", "profile")).alias("profile"), F.min("score").alias("score"))


def fail_closed(forecasts: DataFrame, units: DataFrame) -> DataFrame:
    """Missing forecasts as a tiny share of the median actual, so that they score badly."""
    eps = F.greatest(F.lit(1e-9), 1e-4 * F.col("median_actual"))
    return units.join(forecasts, [c for c in units.columns if c in forecasts.columns], "left").withColumn("volume", F.coalesce("volume", eps))
