"""Scoring a whole self-play run in one job; iterations are a column."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import rewards as R
from textloom.functions.scoring import (
    clarity_score, coherence_score, complexity_score, relevance_score, structure_score,
)
from textloom.functions.text import with_once
from textloom.functions.validation import validate_solution, validate_task
from textloom.operators.diversity import NGRAM_WEIGHTS, closest_earlier_task
from textloom.operators.gating import (
    FORCE_ITERATIONS, FORCE_SOLUTIONS_UNTIL, force_accept_solutions, force_accept_tasks,
)
from textloom.operators.spread import spread
from textloom.operators.storage import cut


# Tasks of this type hold code; only theirs is run.
EXECUTED_TYPE = "induction"


@dataclass(frozen=True)
class RunSettings:
    """Everything that a scored run can set.

    ``task_limits`` and ``solution_limits`` are the named limits of ``validate_task`` and
    ``validate_solution``. ``weights`` multiply rewards by name. The last two say what earlier
    runs have done when a run is resumed: its iterations start after theirs, and
    their accepted tasks count towards ``force_solutions_until``.
    """

    task_limits: dict[str, float] = field(default_factory=dict)
    solution_limits: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    target_complexity: float = 0.7
    complexity_tolerance: float = 0.15
    accuracy_power: float = 1.5
    ngram_weights: tuple[float, ...] = NGRAM_WEIGHTS
    force_tasks: bool = True
    force_solutions: bool = True
    force_iterations: int = FORCE_ITERATIONS
    force_solutions_until: int = FORCE_SOLUTIONS_UNTIL
    iterations_before: int = 0
    valid_tasks_before: int = 0

    def weight(self, reward: str) -> float:
        return self.weights.get(reward, 1.0)


def validated_tasks(tasks: DataFrame, force: bool = True, settings: RunSettings | None = None) -> DataFrame:
    """Tasks with ``validation``, forced acceptance included.

    ``execution_score``, where the column exists, counts for induction tasks only; any other
    task is executable.
    """
    settings = settings or RunSettings()
    execution = None
    if "execution_score" in tasks.columns:
        execution = F.when(F.col("type") == EXECUTED_TYPE, F.col("execution_score"))
    scored = with_once(
        spread(tasks, "iteration", "seq"),
        _complexity=complexity_score(F.col("task")), _clarity=clarity_score(F.col("task")),
    ).withColumn("validation", validate_task(
        F.col("task"), F.col("is_placeholder"), F.col("from_seed"),
        F.col("_complexity"), F.col("_clarity"), execution, **settings.task_limits,
    )).drop("_complexity", "_clarity")
    return force_accept_tasks(scored, threshold=settings.force_iterations - settings.iterations_before,
                              enabled=force and settings.force_tasks)


def score_tasks(tasks: DataFrame, force: bool = True, keys: list[str] = R.TASK_REWARDS,
                settings: RunSettings | None = None) -> DataFrame:
    """Tasks with ``validation`` and ``rewards``; rejected ones only record a total of 0.

    Input: iteration, seq, task, type, from_seed, is_placeholder. The diversity reward
    compares with earlier accepted tasks of the iteration only. The validated rows are cut
    to storage once, as they feed both the comparison and the result.
    """
    settings = settings or RunSettings()
    checked = cut(validated_tasks(tasks, force, settings))
    accepted = checked.where("validation.is_valid")
    closest = closest_earlier_task(accepted, weights=settings.ngram_weights, total_rows=checked.count()).select(
        "iteration", "seq", "max_similarity"
    )
    rewards = R.reward_map({
        "clarity": R.reward_linear(F.col("validation.clarity"), settings.weight("clarity")),
        "complexity": R.reward_complexity(F.col("validation.complexity"), settings.weight("complexity"),
                                          settings.target_complexity, settings.complexity_tolerance),
        "diversity": R.reward_diversity(F.col("max_similarity"), settings.weight("diversity")),
    }, keys)
    return checked.join(closest, ["iteration", "seq"], "left").withColumn(
        "rewards", F.when(F.col("validation.is_valid"), rewards).otherwise(R.rejected_map())
    ).drop("max_similarity")


def validated_solutions(solutions: DataFrame, settings: RunSettings | None = None) -> DataFrame:
    """Solutions with ``validation``.

    ``executed``, where the column exists, says whether the code blocks of the solution text ran;
    it counts for induction tasks only and never for placeholders.
    """
    settings = settings or RunSettings()
    executed = None
    if "executed" in solutions.columns:
        executed = F.when((F.col("type") == EXECUTED_TYPE) & ~F.col("is_placeholder"), F.col("executed"))
    return with_once(
        spread(solutions, "iteration", "seq"),
        _coherence=coherence_score(F.col("solution")),
        _relevance=relevance_score(F.col("task"), F.col("solution")),
        _structure=structure_score(F.col("raw_generation")),
    ).withColumn("validation", validate_solution(
        F.col("solution"), F.col("is_placeholder"), F.col("_coherence"), F.col("_relevance"),
        F.col("_structure"), executed, **settings.solution_limits,
    )).drop("_coherence", "_relevance", "_structure")


def score_solutions(solutions: DataFrame, tasks: DataFrame, force: bool = True,
                    keys: list[str] = R.SOLUTION_REWARDS, settings: RunSettings | None = None) -> DataFrame:
    """Solutions with ``validation`` and ``rewards``.

    Input: iteration, seq, task, solution, raw_generation, is_placeholder and, where code
    ran, ``executed``. ``tasks`` are the validated tasks that decide forced acceptance.
    """
    settings = settings or RunSettings()
    gated = force_accept_solutions(
        validated_solutions(solutions, settings), tasks, threshold=settings.force_solutions_until,
        enabled=force and settings.force_solutions, valid_at_start=settings.valid_tasks_before)
    rewards = R.reward_map({
        "accuracy": R.reward_accuracy(F.col("validation.is_valid"), F.col("validation.correctness"),
                                      settings.weight("accuracy"), settings.accuracy_power),
        "coherence": R.reward_linear(F.col("validation.coherence"), settings.weight("coherence")),
        "relevance": R.reward_linear(F.col("validation.relevance"), settings.weight("relevance")),
        "structure": R.reward_linear(F.col("validation.structure"), settings.weight("structure")),
    }, keys)
    return gated.withColumn(
        "rewards", F.when(F.col("validation.is_valid"), rewards).otherwise(R.rejected_map())
    )
