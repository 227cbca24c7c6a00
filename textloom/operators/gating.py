"""Forced acceptance and the draw of task types and seed tasks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.fixed_values import TASK_TYPE_WEIGHTS, TASK_TYPES
from textloom.functions.prompts import expand_short_task, placeholder_task
from textloom.operators.positions import with_position, with_running_totals
from textloom.operators.skew import HOT_ROWS, join_per_key

FORCE_ITERATIONS = 10
FORCE_SOLUTIONS_UNTIL = 20
FORCED = "Forced accept"


def _forced(validation: Column, force: Column) -> Column:
    """Validation struct with acceptance and reason replaced where forced."""
    return F.when(
        force & ~validation["is_valid"],
        validation.withField("is_valid", F.lit(True)).withField("reason", F.lit(FORCED)),
    ).otherwise(validation)


def force_accept_tasks(df: DataFrame, validation: str = "validation", iteration: str = "iteration",
                       threshold: int = FORCE_ITERATIONS, enabled: bool = True) -> DataFrame:
    """Accept every task of the first ``threshold`` iterations."""
    if not enabled:
        return df
    return df.withColumn(validation, _forced(F.col(validation), F.col(iteration) <= threshold))


def valid_before(tasks: DataFrame, iteration: str = "iteration", is_valid: str = "validation.is_valid") -> DataFrame:
    """(iteration, valid_before): tasks accepted in all earlier iterations."""
    per_iteration = tasks.groupBy(iteration).agg(
        F.count_if(F.col(is_valid)).alias("valid_here")
    )
    return with_running_totals(
        per_iteration, [iteration], {"valid_before": F.col("valid_here")}, inclusive=False
    ).select(iteration, "valid_before")


def force_accept_solutions(df: DataFrame, tasks: DataFrame, validation: str = "validation",
                           iteration: str = "iteration", threshold: int = FORCE_SOLUTIONS_UNTIL,
                           enabled: bool = True, valid_at_start: int = 0) -> DataFrame:
    """Accept solutions while at most ``threshold`` tasks were accepted before the iteration.

    ``valid_at_start`` counts the accepted tasks of the runs that this one resumes.

    The counts never fall, so the iterations concerned are those up to one number, a
    scalar of the plan.
    """
    if not enabled:
        return df
    last = valid_before(tasks, iteration).where(F.col("valid_before") + valid_at_start <= threshold).agg(
        F.max(iteration).alias("last")
    )
    force = F.coalesce(F.col(iteration) <= last.scalar(), F.lit(False))
    return df.withColumn(validation, _forced(F.col(validation), force))


def uniform(*keys: Column) -> Column:
    """Reproducible draw from [0, 1) by 32 bits of a digest of the keys."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def draw_type(draw: Column, types: Sequence[str] = TASK_TYPES,
              weights: Sequence[float] = TASK_TYPE_WEIGHTS) -> Column:
    """Type whose share of the normalised weights holds the draw; equal shares for all-zero weights."""
    total = sum(weights)
    shares = [w / total for w in weights] if total > 0 else [1 / len(types)] * len(types)
    choice, reached = None, 0.0
    for name, share in zip(types[:-1], shares):
        reached += share
        test = draw < F.lit(reached)
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    return F.lit(types[-1]) if choice is None else choice.otherwise(types[-1])


def numbered_seeds(seeds: DataFrame, key: str) -> DataFrame:
    """(type, task, seed_no, seeds): seed tasks numbered per type in key order."""
    placed = with_position(seeds.select("type", "task", key), ["type", key])
    spans = placed.groupBy("type").agg(F.min("pos").alias("start"), F.count("*").alias("seeds"))
    return placed.join(F.broadcast(spans), "type").select(
        "type", "task", (F.col("pos") - F.col("start")).alias("seed_no"), "seeds"
    )


def seed_or_generate(
    draws: DataFrame, seeds: DataFrame, seed_key: str, seed: int = 0,
    iteration: str = "iteration", seq: str = "seq", probability: float = 0.2,
    types: Sequence[str] = TASK_TYPES, weights: Sequence[float] = TASK_TYPE_WEIGHTS,
    hot_rows: int = HOT_ROWS, generated: str | None = None,
) -> DataFrame:
    """Add ``type``, ``from_seed`` and ``seed_task`` to each draw.

    A seed task is used with the given probability where the type has any; which one is
    another draw. A seed task that very many draws pick is joined as a hot key.

    ``generated`` names a column with the text a generation gave, null where it failed. A
    failed one takes a seed task of the drawn type too, by the same draw, and where the type
    has none a placeholder. Then ``task`` and ``is_placeholder`` are added as well.
    """
    keys = [F.lit(seed), F.col(iteration), F.col(seq)]
    numbered = numbered_seeds(seeds.where(F.col("type").isin(list(types))), seed_key)
    counts = numbered.groupBy("type").agg(F.max("seeds").alias("seeds"))
    drawn = draws.withColumn("type", draw_type(uniform(F.lit("type"), *keys), types, weights))
    wanted = uniform(F.lit("seed"), *keys) < probability
    if generated is not None:
        wanted = wanted | F.col(generated).isNull()
    sized = drawn.join(F.broadcast(counts), "type", "left").withColumn("seed_no", F.when(
        (F.col("seeds") > 0) & wanted,
        F.floor(uniform(F.lit("pick"), *keys) * F.col("seeds")),
    )).drop("seeds")
    seeded = sized.where("seed_no is not null")
    draws_of = seeded.groupBy("type", "seed_no").agg(F.count("*").alias("draws"))
    picked = numbered.select("type", "seed_no", F.col("task").alias("seed_task")).join(
        draws_of, ["type", "seed_no"]
    )
    found = join_per_key(seeded, picked, ["type", "seed_no"], "draws", hot_rows=hot_rows)
    others = sized.where("seed_no is null").select(
        "*", F.lit(None).cast("string").alias("seed_task"), F.lit(False).alias("from_seed")
    )
    chosen = found.drop("draws").withColumn("from_seed", F.lit(True)).unionByName(others)
    if generated is None:
        return chosen
    made = F.coalesce(F.col("seed_task"), expand_short_task(F.col(generated), F.col("type")))
    return chosen.withColumn("task", F.coalesce(made, placeholder_task(F.col("type")))).withColumn(
        "is_placeholder", ~F.col("from_seed") & F.col(generated).isNull())
