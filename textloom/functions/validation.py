"""Acceptance of tasks and solutions from their scores."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import blank_words

TASK_TOO_SHORT, TASK_TOO_LONG = 15, 2500


def _result(valid: Column, reason: Column, **metrics: Column) -> Column:
    return F.struct(
        valid.alias("is_valid"), *[c.cast("double").alias(k) for k, c in metrics.items()],
        reason.alias("reason"),
    )


def validate_task(
    task: Column, is_placeholder: Column, from_seed: Column, complexity: Column,
    clarity: Column, execution: Column | None = None,
    min_complexity: float = 0.2, min_clarity: float = 0.4,
    min_length: int = TASK_TOO_SHORT, max_length: int = TASK_TOO_LONG,
) -> Column:
    """STRUCT(is_valid, complexity, clarity, executability, reason).

    Placeholders pass with fixed scores; a wrong length fails without scores; seed tasks
    pass whatever their scores. ``execution`` is reported and does not decide.
    """
    length = F.coalesce(F.length(task), F.lit(0))
    nothing = F.lit(None).cast("double")
    passed = ((complexity >= min_complexity) & (clarity >= min_clarity)) | from_seed
    executability = F.lit(1.0) if execution is None else F.coalesce(execution, F.lit(1.0))
    wrong = F.when(length < min_length, "Task too short").when(length > max_length, "Task too long")
    scored = ~is_placeholder & wrong.isNull()

    def metric(value: Column, placeholder: float) -> Column:
        return F.when(is_placeholder, placeholder).when(scored, value).otherwise(nothing)

    return _result(
        F.coalesce(is_placeholder | (scored & passed), F.lit(False)),
        F.when(is_placeholder, "Placeholder task accepted").when(wrong.isNotNull(), wrong)
        .when(~passed, "Failed metric thresholds"),
        complexity=metric(complexity, 0.5), clarity=metric(clarity, 0.5),
        executability=metric(executability, 1.0),
    )


def validate_solution(
    solution: Column, is_placeholder: Column, coherence: Column, relevance: Column,
    structure: Column, executed: Column | None = None,
    min_coherence: float = 0.4, min_relevance: float = 0.4, min_structure: float = 0.3,
    min_correctness: float = 0.45, min_correctness_executed: float = 0.4,
) -> Column:
    """STRUCT(is_valid, correctness, coherence, relevance, structure, reason).

    ``executed`` is null when no code ran, else whether it succeeded; it then replaces
    the four thresholds by one on the adjusted correctness. Texts of at least 50 words
    pass when no code ran.
    """
    ran = F.lit(None).cast("boolean") if executed is None else executed
    nothing = F.lit(None).cast("double")
    words = F.size(blank_words(solution))
    empty = F.coalesce(solution, F.lit("")) == ""
    short = ~empty & (words < 10)
    scored = ~is_placeholder & ~empty & ~short
    heuristic = (coherence + relevance + structure) / 3
    correctness = (
        F.when(ran.isNull() | short, heuristic)
        .when(ran, F.greatest(heuristic, F.lit(0.8))).otherwise(heuristic * 0.5)
    )
    thresholds = (
        (coherence >= min_coherence) & (relevance >= min_relevance)
        & (structure >= min_structure) & (heuristic >= min_correctness)
    )
    accepted = F.when(ran.isNull(), thresholds | (words >= 50)).otherwise(
        correctness >= min_correctness_executed
    )
    too_short_valid = F.when(ran, True).otherwise(False)  # success lifts correctness to .8
    valid = (
        F.when(is_placeholder, True).when(empty, False)
        .when(short, too_short_valid).otherwise(accepted)
    )
    reason = (
        F.when(is_placeholder, "Placeholder solution accepted")
        .when(empty, "Empty solution")
        .when(ran, "Execution successful, combined with heuristics")
        .when(~ran, "Execution failed, heuristic score penalized")
        .when(short, "Solution too short")
        .when(~accepted, "Failed heuristic metric thresholds")
    )

    def metric(value: Column) -> Column:
        return F.when(is_placeholder, 0.5).when(scored, value).otherwise(nothing)

    rejected = F.when(short & ran, 0.8).otherwise(0.0)
    return _result(
        valid, reason,
        correctness=F.when(is_placeholder, 0.5).when(scored, correctness).otherwise(rejected),
        coherence=metric(coherence), relevance=metric(relevance), structure=metric(structure),
    )
