"""Counters and averages over scored tasks and solutions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.positions import with_running_totals
from textloom.operators.storage import cut

VALID = "validation.is_valid"


def task_counts(df: DataFrame, is_valid: str = VALID) -> DataFrame:
    """One row: generated, valid, rate."""
    return df.agg(
        F.count("*").alias("generated"), F.count_if(F.col(is_valid)).alias("valid")
    ).withColumn("rate", F.col("valid") / F.greatest(F.lit(1), F.col("generated")))


def task_type_counts(df: DataFrame, type_col: str = "type") -> DataFrame:
    """(type, n); a missing type counts as ``unknown``."""
    return df.groupBy(F.coalesce(F.col(type_col), F.lit("unknown")).alias("type")).agg(
        F.count("*").alias("n")
    )


def avg_rewards_by_key(df: DataFrame, rewards: str = "rewards") -> DataFrame:
    """(key, average) over the rows that have the key; rejected rows only have a total."""
    return df.select(F.explode(rewards).alias("key", "value")).groupBy("key").agg(
        F.avg("value").alias("average")
    )


def iteration_rates(df: DataFrame, iteration: str = "iteration", is_valid: str = VALID) -> DataFrame:
    """(iteration, attempted, valid, rate)."""
    return df.groupBy(iteration).agg(
        F.count("*").alias("attempted"), F.count_if(F.col(is_valid)).alias("valid")
    ).withColumn("rate", F.col("valid") / F.col("attempted"))


def mean_iteration_rate(per_iteration: DataFrame, iterations: DataFrame | None = None,
                        iteration: str = "iteration") -> DataFrame:
    """One row: unweighted mean of the rates; listed iterations without attempts count 0."""
    rates = per_iteration.select(iteration, "rate")
    if iterations is not None:
        rates = iterations.select(iteration).distinct().join(rates, iteration, "left")
    return rates.agg(F.coalesce(F.avg(F.coalesce("rate", F.lit(0.0))), F.lit(0.0)).alias("mean_rate"))


def running_task_metrics(df: DataFrame, iteration: str = "iteration", seq: str = "seq",
                         is_valid: str = VALID) -> DataFrame:
    """Counters after every task and the name of its record."""
    flagged = df.select(iteration, seq, F.col(is_valid).cast("int").alias("_valid"))
    counted = with_running_totals(
        flagged, [iteration, seq], {"generated": F.lit(1), "valid": F.col("_valid")}
    )
    return counted.drop("_valid").withColumn("record", F.concat(
        F.lit("task_"),
        F.when(F.col("generated") < 1_000_000, F.lpad(F.col("generated").cast("string"), 6, "0"))
        .otherwise(F.col("generated").cast("string")),
    ))


def _tally(df: DataFrame, iteration: str, rewards: str, type_col: str | None, is_valid: str) -> DataFrame:
    """(kind, key, n, values, total): rows per iteration and type, and sums per reward key.

    One scan and one aggregation with map-side sums; the few rows that come out are stored.
    """
    def fact(kind: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    facts = [fact("iteration", F.col(iteration), F.coalesce(F.col(is_valid), F.lit(False)).cast("int"))]
    if type_col:
        facts.append(fact("type", F.coalesce(F.col(type_col), F.lit("unknown")), F.lit(0)))
    of_rewards = F.transform(F.map_entries(rewards), lambda e: fact("reward", e["key"], e["value"]))
    every = F.when(F.col(rewards).isNull(), F.array(*facts)).otherwise(F.concat(F.array(*facts), of_rewards))
    return cut(df.select(F.inline(every)).groupBy("kind", "key").agg(
        F.count("*").alias("n"), F.count("value").alias("values"), F.sum("value").alias("total")))


def run_summary(tasks: DataFrame, solutions: DataFrame, iteration: str = "iteration",
                rewards: str = "rewards", type_col: str = "type", is_valid: str = VALID) -> DataFrame:
    """(metric, value): counts, rates, counts per type and mean rewards of a whole run.

    Metrics of nested groups have dotted names such as ``task_types.induction``. Each
    table is read once; all metrics come from its sums.
    """
    def named(df: DataFrame, name: Column, value: Column) -> DataFrame:
        return df.select(name.alias("metric"), value.cast("double").alias("value"))

    of_tasks = _tally(tasks, iteration, rewards, type_col, is_valid)
    of_solutions = _tally(solutions, iteration, rewards, None, is_valid)
    iterations = of_tasks.where("kind = 'iteration'")
    parts = [named(iterations.agg(F.count("*").alias("n")), F.lit("iterations"), F.col("n"))]
    for tally, one in ((of_tasks, "task"), (of_solutions, "solution")):
        rows = tally.where("kind = 'iteration'")
        sums = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("valid"))
        parts.append(sums.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in (
                (f"{one}s_generated", F.col("n")), (f"{one}s_valid", F.col("valid")),
                (f"{one}_valid_rate", F.col("valid") / F.greatest(F.lit(1), F.col("n"))))]))))
        parts.append(named(tally.where("kind = 'reward' and values > 0"), F.concat(F.lit(f"avg_{one}_rewards."), "key"),
                           F.col("total") / F.col("values")))
        # Iterations without attempts count 0.
        rates = iterations.select("key").join(rows.select("key", (F.col("total") / F.col("n")).alias("rate")), "key", "left")
        parts.append(named(rates.agg(F.coalesce(F.avg(F.coalesce("rate", F.lit(0.0))), F.lit(0.0)).alias("rate")),
                           F.lit(f"avg_validation_rates.{one}s"), F.col("rate")))
    parts.append(named(of_tasks.where("kind = 'type'"), F.concat(F.lit("task_types."), "key"), F.col("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
