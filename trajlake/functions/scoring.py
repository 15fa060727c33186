"""Column functions that grade tasks and trajectories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers, classes and weights of the scoring scheme.
TIERS = (("PLATINUM", 0.95), ("GOLD", 0.9), ("SILVER", 0.75), ("BRONZE", 0.6))
TIER_ORDER = ("FAILED", "BRONZE", "SILVER", "GOLD", "PLATINUM")
TASK_TYPES = (
    ("cancellation", "cancel"),
    ("booking", "book|reservation"),
    ("modification", "modify|change|update"),
    ("inquiry", "check|status|track|query"),
    ("compensation", "compensat|refund|delay"),
    ("exchange", "exchange|return"),
    ("service_control", "suspend|resume"),
    ("billing", "payment|bill"),
)
PARAMETER_WEIGHTS = {"completeness": 0.4, "parameters": 0.4, "reasoning": 0.2}
RECOVERY_WEIGHTS = {"completeness": 0.35, "parameters": 0.35, "recovery": 0.30}
# End of fixed values.


def ratio(part: Column, whole: Column, default: float | None = None) -> Column:
    out = F.try_divide(part.cast("double"), whole.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def reward_tier(reward: Column) -> Column:
    start = F.when(reward >= TIERS[0][1], TIERS[0][0])
    return reduce(lambda c, t: c.when(reward >= t[1], t[0]), TIERS[1:], start).otherwise("FAILED")


def should_save(reward: Column, least: str = "BRONZE") -> Column:
    order = F.array(*map(F.lit, TIER_ORDER))
    return F.array_position(order, reward_tier(reward)) >= F.array_position(order, F.lit(least))


def task_type(reason: Column) -> Column:
    """The first keyword that occurs, in the fixed order; else ``other``."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    start = F.when(low.rlike(TASK_TYPES[0][1]), TASK_TYPES[0][0])
    return reduce(lambda c, t: c.when(low.rlike(t[1]), t[0]), TASK_TYPES[1:], start).otherwise("other")


def complexity(n_actions: Column) -> Column:
    return F.when(n_actions <= 2, "simple").when(n_actions <= 5, "medium").otherwise("complex")


def difficulty_weight(n_actions: Column, sensitive: Column, long_text: Column, n_weak: Column, fail_rate: Column) -> Column:
    """1, plus 1 for three actions or more, 1.5 if sensitive, 1 for complex text, 0.5 for each weak tool; times 1 + fail rate; 5 at most."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    base = 1.0 + flag(n_actions >= 3) + 1.5 * flag(sensitive) + flag(long_text) + 0.5 * F.coalesce(n_weak, F.lit(0))
    return F.least(F.lit(5.0), base * (1 + F.coalesce(fail_rate, F.lit(0.0))))


def adjusted_max_steps(steps: Column, multi_step: Column, complex_text: Column) -> Column:
    raised = F.when(multi_step, F.greatest(steps, F.lit(150))).otherwise(steps)
    return F.when(complex_text, F.floor(raised * 1.2)).otherwise(raised).cast("int")


def quality_score_v1(completeness: Column, parameters: Column, reasoning_turns: Column) -> Column:
    w = PARAMETER_WEIGHTS
    return w["completeness"] * completeness + w["parameters"] * parameters + w["reasoning"] * F.least(reasoning_turns / 3, F.lit(1.0))


def quality_score_v2(completeness: Column, parameters: Column, recoveries: Column, errors: Column) -> Column:
    w = RECOVERY_WEIGHTS
    return w["completeness"] * completeness + w["parameters"] * parameters + w["recovery"] * ratio(recoveries, errors, 1.0)


def final_reward(action: Column, communicate: Column, conditions: Column) -> Column:
    """Mean of the communicate and condition rewards that exist; else the action reward; else 1."""
    parts = F.array_compact(F.array(communicate, conditions))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    return F.when(F.size(parts) > 0, mean).otherwise(F.coalesce(action, F.lit(1.0)))
