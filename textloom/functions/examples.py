"""Model-ready examples as array expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let

IGNORE = -100  # label value the training loss skips


def pad_right(ids: Column, length: int, pad: int) -> Column:
    missing = F.lit(length) - F.size(ids)  # not above 0: nothing is repeated
    return F.concat(ids, F.array_repeat(F.lit(pad), missing))


def attention_mask(ids: Column, pad: int) -> Column:
    """1 where the id is not the pad id; a real token with that id is masked as well."""
    return F.transform(ids, lambda i: F.when(i == pad, 0).otherwise(1))


def pretrain_example(ids: Column, max_length: int, pad: int = 0) -> Column:
    """STRUCT(input_ids, attention_mask, labels), each of exactly ``max_length``."""
    def example(padded: Column) -> Column:
        labels = F.transform(padded, lambda i: F.when(i == pad, F.lit(IGNORE)).otherwise(i))
        return F.struct(
            padded.alias("input_ids"), attention_mask(padded, pad).alias("attention_mask"),
            labels.alias("labels"),
        )

    return let(F.slice(ids, 1, max_length), lambda cut: let(pad_right(cut, max_length, pad), example))


def sft_example(prompt: Column, output: Column, max_length: int, pad: int = 0,
                eos: int = 2) -> Column:
    """STRUCT(input_ids, attention_mask, labels) of prompt + output + end mark.

    Too long sequences are cut and closed by the end mark. Labels are hidden on
    the prompt and on pad ids, except a final end mark behind the prompt.
    """
    def cut(whole: Column) -> Column:
        return F.when(
            F.size(whole) > max_length,
            F.concat(F.slice(whole, 1, max_length - 1), F.array(F.lit(eos))),
        ).otherwise(whole)

    whole = let(F.concat(prompt, output, F.array(F.lit(eos))), cut)
    return labelled_example(whole, F.size(prompt), max_length, pad, eos)


def labelled_example(ids: Column, prompt_length: Column, max_length: int, pad: int,
                     eos: int) -> Column:
    """Pad ``ids`` and hide the labels of the first ``prompt_length`` positions."""

    def example(ids: Column, size: Column, hidden: Column) -> Column:
        def label(i: Column, pos: Column) -> Column:
            closing = (pos == size - 1) & (i == eos) & (hidden < size)
            return F.when(closing, i).when((pos < hidden) | (i == pad), F.lit(IGNORE)).otherwise(i)

        return let(pad_right(ids, max_length, pad), lambda padded: F.struct(
            padded.alias("input_ids"), attention_mask(padded, pad).alias("attention_mask"),
            F.transform(padded, label).alias("labels"),
        ))

    return let(ids, lambda i: let(F.size(i), lambda size: let(
        F.least(prompt_length, size), lambda hidden: example(i, size, hidden)
    )))


def prepend_bos(ids: Column, bos: int = 1) -> Column:
    """Start mark in front, unless it is there already."""
    return F.when(F.get(ids, F.lit(0)) == bos, ids).otherwise(
        F.concat(F.array(F.lit(bos)), ids)
    )
