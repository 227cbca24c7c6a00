"""Conversations as prompts and as instruction/output pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.prompts import chat_line
from textloom.operators.skew import join_per_key

BLOCK_TURNS = 1000


def chat_prompt(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """(conv, turn, prompt): the prompt for the last user turn of each conversation.

    Earlier turns stand as ``Role: content`` lines in order, then the message and an open
    ``Assistant:`` line. Lines are first joined per block of turns, so no task sorts
    a whole conversation; the prompt itself is one value by nature.
    """
    last = df.groupBy(conv).agg(
        F.max(F.when(F.col(role) == "user", F.col(turn))).alias("last"), F.count("*").alias("turns")
    ).where("last is not null")
    lines = join_per_key(df, last, [conv], "turns").where(F.col(turn) <= F.col("last"))
    blocks = lines.groupBy(conv, "last", F.floor(F.col(turn) / BLOCK_TURNS).alias("block")).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(turn, chat_line(F.col(role), F.col(text)).alias("line")))),
            lambda x: x["line"],
        ), "\n").alias("lines")
    )
    return blocks.groupBy(conv, F.col("last").alias(turn)).agg(
        F.concat(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("block", "lines"))), lambda x: x["lines"]
        ), "\n"), F.lit("\nAssistant:")).alias("prompt")
    )


def chat_pairs(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """(conv, turn, instruction, output) of a user turn and the assistant turn after it.

    An equi-join on conversation and turn number: a very long conversation spreads over
    all tasks, which a window per conversation would not.
    """
    asked = df.where(F.col(role) == "user").select(conv, turn, F.col(text).alias("instruction"))
    answered = df.where(F.col(role) == "assistant").select(
        conv, (F.col(turn) - 1).alias(turn), F.col(text).alias("output")
    )
    return asked.join(answered, [conv, turn])
