"""Rewards from validation results; a missing metric counts as 0."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TASK_REWARDS = ["clarity", "complexity", "diversity"]
SOLUTION_REWARDS = ["accuracy", "coherence", "relevance", "structure"]


def _or_zero(metric: Column) -> Column:
    return F.coalesce(metric, F.lit(0.0))


def reward_complexity(complexity: Column, weight: float = 1.0, target: float = 0.7,
                      tolerance: float = 0.15) -> Column:
    """Bell curve around the target complexity."""
    distance = _or_zero(complexity) - target
    return F.exp(-(distance * distance) / (2 * tolerance**2)) * weight


def reward_linear(metric: Column, weight: float = 1.0) -> Column:
    return _or_zero(metric) * weight


def reward_accuracy(is_valid: Column, correctness: Column, weight: float = 1.0,
                    power: float = 1.5) -> Column:
    return F.when(is_valid, F.pow(_or_zero(correctness), F.lit(power)) * weight).otherwise(0.0)


def reward_diversity(max_prior_similarity: Column, weight: float = 1.0) -> Column:
    """Full weight for the first task, less the likeness to the closest earlier one."""
    return (F.lit(1.0) - F.coalesce(max_prior_similarity, F.lit(0.0))) * weight


def reward_map(rewards: dict[str, Column], keys: Sequence[str]) -> Column:
    """MAP of the chosen rewards in key order, with their sum as ``total``."""
    chosen = [k for k in keys if k in rewards]
    total = sum((rewards[k] for k in chosen), F.lit(0.0))
    pairs = [x for k in chosen for x in (F.lit(k), rewards[k])]
    return F.create_map(*pairs, F.lit("total"), total)


def rejected_map() -> Column:
    """What a rejected row records: only a total of 0."""
    return F.create_map(F.lit("total"), F.lit(0.0))


def reward_total(rewards: Column) -> Column:
    """Sum of the reward values without the total itself."""
    parts = F.map_filter(rewards, lambda k, _: k != "total")
    return F.aggregate(F.map_values(parts), F.lit(0.0), lambda total, v: total + v)
