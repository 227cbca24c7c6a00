"""Input tables of the registered queries, derived from the given tables by Spark."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.prompts import (
    expand_short_task, extract_answer, extract_task, placeholder_solution, placeholder_task,
)
from textloom.functions.text import with_once
from textloom.operators.gating import draw_type, uniform
from textloom.operators.spread import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def digest(prefix: str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(prefix), *[F.col(k).cast("string") for k in keys]))


def dressed(text: Column, h: Column, forms: dict[str, Column]) -> Column:
    """Text dressed by the first digit of a digest, so that every reader branch occurs."""
    first = F.substring(h, 1, 1)
    out = F
    for digit, form in forms.items():
        out = out.when(first == digit, form)
    return out.otherwise(text)


def typed_turns(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as raw task generations with iteration, sequence number and type."""
    t = F.col("text")
    raw = dressed(t, F.col("h"), {
        "0": F.concat(F.lit("Task: "), t),
        "1": F.concat(F.lit("Problem:"), t),
        "2": F.concat(F.lit("Short\n"), t, F.lit("\nthird\nfourth")),
        "3": F.concat(t, F.lit("\n```python\nprint(1 + 2)\n```")),
        "4": F.concat(t, F.lit(" If x >= 3 and y <= 10.5 then is 2 + 3 * 4 == 14, or not?")),
        "5": F.lit("  \n"),
        "6": F.lit("Question: Why?"),
    })
    turns = spread(table(spark, sf, "conversations").where("role = 'user'"), "conv_id", "turn")
    keyed = turns.select(
        "conv_id", "turn", F.floor(F.col("conv_id") / 5 + 1).alias("iteration"),
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("seq"),
        digest("t", "conv_id", "turn").alias("h"), "text",
    )
    draw = uniform(F.lit("type"), F.lit(0), F.col("iteration"), F.col("seq"))
    return keyed.withColumn("raw", raw).withColumn("type", draw_type(draw)).drop("text")


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks read from the generations; failed generations become placeholders."""
    found = with_once(typed_turns(spark, sf), found=extract_task(F.col("raw")))
    return found.select(
        "conv_id", "turn", "iteration", "seq", "type", "raw", "found",
        F.coalesce(expand_short_task(F.col("found"), F.col("type")), placeholder_task(F.col("type"))).alias("task"),
        (F.substring("h", 2, 1) == "a").alias("from_seed"), F.col("found").isNull().alias("is_placeholder"),
    )


def raw_solutions(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as raw generations for the user turn before them."""
    t = F.col("text")
    raw = dressed(t, digest("s", "conv_id", "turn"), {
        "0": F.concat(F.lit("Steps.\n<answer> "), t, F.lit("</answer>\n<answer>no</answer>")),
        "1": F.concat(F.lit("1. "), F.replace(t, F.lit(". "), F.lit(".\n2) "))),
        "2": F.concat(t, F.lit("\n```\nx = 1\n```\nTherefore, x.")),
        "3": F.lit(" "),
        "4": F.concat(F.lit("- First, because "), t, F.lit("\n\nConclusion: thus it holds.")),
        "5": F.lit("Too short"),
    })
    rows = table(spark, sf, "conversations").where("role = 'assistant'")
    numbered = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return numbered.select("conv_id", "turn", raw.alias("raw_generation"))


def solutions(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Solutions of the given tasks; failed generations become placeholders."""
    of = tasks(spark, sf) if of is None else of
    joined = raw_solutions(spark, sf).join(
        of.select("conv_id", "turn", "iteration", "seq", "type", "task"), ["conv_id", "turn"]
    )
    read = with_once(joined, answer=extract_answer(F.col("raw_generation")))
    return read.select(
        "conv_id", "turn", "iteration", "seq", "type", "task",
        F.coalesce("answer", placeholder_solution(F.col("task"), F.col("type"))).alias("solution"),
        F.when(F.col("answer").isNull(), "").otherwise(F.col("raw_generation")).alias("raw_generation"),
        F.col("answer").isNull().alias("is_placeholder"),
    )


def web_records(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as archive records; a digest of the address stands in for the server's answer."""
    d = F.substring(F.md5("url"), 1, 1)
    return table(spark, sf, "pages").select(
        "page_id", "url", F.col("html").alias("body"),
        F.when(d == "0", "request").otherwise("response").alias("rec_type"),
        F.when(d == "1", "404").when(d != "2", "200").alias("http_status"),
    )
