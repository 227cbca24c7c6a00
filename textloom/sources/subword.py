"""Token ids from a subword tokenizer file."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """Tokenizer of a JSON file all workers can read; loaded once per worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_udf(path: str, max_length: int | None, special: bool = True) -> Column:
    """Arrow UDF text -> ARRAY<INT>, cut to ``max_length`` special tokens included."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load_tokenizer(path)
        tokenizer.no_padding()
        if max_length is None:
            tokenizer.no_truncation()
        else:
            tokenizer.enable_truncation(max_length)
        for batch in batches:
            texts = batch.to_pylist()
            coded = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=special)
            yield pa.array(
                [None if t is None else c.ids for t, c in zip(texts, coded)], pa.list_(pa.int32())
            )

    return F.arrow_udf(encode, "array<int>")


def tokenize_subword(df: DataFrame, text_col: str, path: str, max_length: int = 2048) -> DataFrame:
    """Add ``input_ids``: subword ids with special tokens, truncated, not padded."""
    return df.withColumn("input_ids", encode_udf(path, max_length)(F.col(text_col)))


def prompt_length(prompt: Column, prompt_with_special: Column, full: Column, eos: int,
                  bos: int | None) -> Column:
    """Number of leading ids of ``full`` that belong to the prompt.

    Usually the prompt with its special tokens is a prefix of the whole. Where it closes
    with the end mark, or is no prefix, the bare prompt counts, plus a start mark that
    only the whole carries.
    """
    n = F.size(prompt)
    is_prefix = F.slice(full, 1, F.size(prompt_with_special)) == prompt_with_special
    closes = F.get(prompt_with_special, F.size(prompt_with_special) - 1) == eos
    if bos is None:
        bare_in_prefix = bare_in_full = n
    else:
        starts = F.coalesce(F.get(prompt_with_special, F.lit(0)) == bos, F.lit(False))
        has_own = F.coalesce(F.get(prompt, F.lit(0)) == bos, F.lit(False))
        bare_in_prefix = n + F.when(starts & ~has_own, 1).otherwise(0)
        bare_in_full = n + F.when(F.coalesce(F.get(full, F.lit(0)) == bos, F.lit(False)), 1).otherwise(0)
    return F.when(
        is_prefix, F.when(F.coalesce(closes, F.lit(False)), bare_in_prefix)
        .otherwise(F.size(prompt_with_special))
    ).otherwise(bare_in_full)


def sft_example_hf(df: DataFrame, prompt_col: str, text_col: str, path: str, max_length: int,
                   eos_token: str, pad_token: str | None = None,
                   bos_token: str | None = None) -> DataFrame:
    """Add input_ids, attention_mask and labels of subword fine-tuning examples.

    The end mark is appended to the text; without a pad token the end mark pads.
    """
    from textloom.functions.examples import labelled_example

    tokenizer = load_tokenizer(path)
    eos = tokenizer.token_to_id(eos_token)
    if eos is None:
        raise ValueError(f"the tokenizer has no token {eos_token!r}")
    pad = eos if pad_token is None else tokenizer.token_to_id(pad_token)
    bos = None if bos_token is None else tokenizer.token_to_id(bos_token)
    prompt = F.col(prompt_col)
    coded = df.withColumns({
        "_bare": encode_udf(path, None, special=False)(prompt),
        "_special": encode_udf(path, max_length)(prompt),
        "_full": encode_udf(path, max_length)(F.concat(F.col(text_col), F.lit(eos_token))),
    })
    length = prompt_length(F.col("_bare"), F.col("_special"), F.col("_full"), eos, bos)
    example = labelled_example(F.col("_full"), length, max_length, pad, eos)
    return coded.withColumn("_example", example).select(*df.columns, "_example.*")
