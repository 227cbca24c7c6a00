"""Language identification by character trigrams of words.

The model is a table of integer log-probabilities, so sums are exact and do not depend
on row order. A model that fits a worker scores each text where it is read.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.skew import HOT_ROWS, join_per_key
from textloom.operators.spread import spread
from textloom.operators.storage import cut

SCALE = 10_000  # log-probabilities are kept as integers of 1/SCALE
MAX_MODEL_CELLS = 4_000_000  # 32 MB
MAX_LANGUAGES = 500


# Bytes of text whose trigrams a worker holds at once (one text may hold more).
SLICE_BYTES = 1 << 20


def _all_codes(text: str) -> np.ndarray:
    """Trigrams of a text as 63-bit codes, 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text with counts."""
    return np.unique(_all_codes(text), return_counts=True)


def _slices(batch: pa.RecordBatch | pa.Array, texts: pa.Array) -> Iterator:
    """Parts of a batch whose texts reach ``SLICE_BYTES`` at their last row at the latest."""
    sizes = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = min(len(texts), int(np.searchsorted(sizes, before + SLICE_BYTES)) + 1)
        yield batch.slice(start, end - start)
        start = end


def _count_codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.concat_arrays([_counted(part) for part in _slices(batch, batch)] or [_counted(batch)])


def _counted(texts: pa.Array) -> pa.Array:
    found = [_codes(text or "") for text in texts.to_pylist()]
    grams = np.concatenate([g for g, _ in found] or [[]]).astype(np.int64)
    times = np.concatenate([n for _, n in found] or [[]]).astype(np.int64)
    ends = np.cumsum([0] + [len(g) for g, _ in found])
    pairs = pa.StructArray.from_arrays([grams, times], ["gram", "times"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def _rows_of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, times) of (key, text), slice by slice; a text without trigrams has one row with a null gram, once."""
    for batch in batches:
        for part in _slices(batch, batch.column(1)):
            lists = _counted(part.column(1))
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            pairs, bare = lists.flatten(), np.flatnonzero(lengths == 0)
            key = part.column(0).take(pa.array(np.concatenate([np.repeat(np.arange(len(lengths)), lengths), bare])))
            yield pa.RecordBatch.from_arrays([
                key, pa.concat_arrays([pairs.field("gram"), pa.nulls(len(bare), pa.int64())]),
                pa.concat_arrays([pairs.field("times"), pa.array(np.ones(len(bare), np.int64))]),
            ], ["key", "gram", "times"])


def _rows_of_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, times) of (key, text) summed over the texts of a key in a slice."""
    for batch in batches:
        for part in _slices(batch, batch.column(1)):
            keys = part.column(0).dictionary_encode()
            texts = part.column(1).to_pylist()
            at = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for k in np.unique(at):
                codes = np.concatenate([_all_codes(texts[i] or "") for i in np.flatnonzero(at == k)])
                grams, times = np.unique(codes, return_counts=True)
                key = keys.dictionary.take(pa.array(np.full(len(grams), k), mask=np.full(len(grams), k < 0)))
                yield pa.RecordBatch.from_arrays([key, pa.array(grams, pa.int64()), pa.array(times, pa.int64())], ["key", "gram", "times"])


def _trigram_rows(df: DataFrame, key: str, text_col: str, run: Callable) -> DataFrame:
    """(key, gram, times) of the padded letters of a text, made in slices: no list of a whole batch is held."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), _padded_letters(F.col(text_col)).alias("text")).mapInArrow(
        run, f"key {kind}, gram bigint, times bigint")


def _padded_letters(text: Column) -> Column:
    letters = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.concat(F.lit(" "), letters, F.lit(" "))


def trigram_counts(text: Column) -> Column:
    """ARRAY of (gram, times): three-character pieces of the lower-cased text.

    What is not a letter becomes one blank, and a blank stands at both ends. A gram is its
    three code points in one BIGINT, which keeps the exploded rows short.
    """
    count = F.arrow_udf(_count_codes, "array<struct<gram: bigint, times: bigint>>")
    return count(_padded_letters(text))


def train_language_model(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id"
) -> DataFrame:
    """(lang, gram, logp): add-one smoothed log-probability of each trigram.

    The counts, one row per language and trigram, are cut to storage. The row with a null gram holds what a trigram unseen in that language gets.
    """
    counts = cut(
        _trigram_rows(spread(df.select(id_col, lang_col, text_col), id_col), lang_col, text_col, _rows_of_language)
        .withColumnRenamed("key", "lang")
        .groupBy("lang", "gram")
        .agg(F.sum("times").alias("n"))
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    rows = counts.unionByName(totals.select("lang", F.lit(None).cast("long").alias("gram"), F.lit(0).alias("n")))
    logp = F.log((F.col("n") + 1.0) / (F.col("total") + F.col("kinds") + 1.0))
    return rows.join(totals, "lang").select(
        "lang", "gram", F.round(logp * SCALE).cast("long").alias("logp")
    )


def language_bases(model: DataFrame) -> dict[str, int]:
    """Unseen-trigram value per language; one short row per language."""
    rows = model.where("gram is null").select("lang", "logp").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the model")
    return {r.lang: r.logp for r in sorted(rows)}


def _gains(model: DataFrame, bases: dict[str, int]) -> DataFrame:
    """(gram, one column per language): what knowing the trigram adds to the base."""
    return model.where("gram is not null").groupBy("gram").agg(*[
        F.max(F.when(F.col("lang") == lang, F.col("logp") - F.lit(base))).alias(f"s_{lang}")
        for lang, base in bases.items()
    ]).na.fill(0)


def lang_scores(df: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hot_rows: int = HOT_ROWS) -> tuple[DataFrame, list[str]]:
    """(id, one score column per language) and the languages in name order.

    A score is the sum of logp over the text's trigrams, repeats included. Trigram rows
    are shuffled to the model, frequent trigrams as hot keys, so neither side has to fit
    a worker.
    """
    bases = language_bases(model)
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    # Stored, as three plans read them: trigrams are made once.
    # A text without trigrams has one row, which scores the bases.
    pieces = cut(_trigram_rows(texts, "id", "text", _rows_of_text).withColumnRenamed("key", "id"))
    texts_of = pieces.groupBy("gram").agg(F.count("*").alias("texts"))
    known = join_per_key(
        pieces, _gains(model, bases).join(texts_of, "gram"), ["gram"], "texts", hot_rows=hot_rows
    )
    parts = pieces.select(
        "id", *[(F.col("times") * base).alias(lang) for lang, base in bases.items()]
    ).unionByName(known.select(
        "id", *[(F.col("times") * F.col(f"s_{lang}")).alias(lang) for lang in bases]
    ))
    scored = parts.groupBy(F.col("id").alias(id_col)).agg(*[F.sum(lang).alias(lang) for lang in bases])
    return scored, list(bases)


def _predictor(rows: pa.Table, bases: dict[str, int]) -> Callable[[Column], Column]:
    """Arrow UDF from padded letters to the language, with the model as sorted arrays."""
    table = np.stack([c.to_numpy() for c in rows.columns], axis=1).astype(np.int64).reshape(-1, 1 + len(bases))
    table = table[np.argsort(table[:, 0])]
    names, base = list(bases), np.array(list(bases.values()), np.int64)
    known, gain = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1:])

    def best(text: str) -> str:
        grams, times = _codes(text)
        at = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
        hit = known[at] == grams if len(known) else np.zeros(len(grams), bool)
        score = times[hit] @ gain[at[hit]] + max(1, times.sum()) * base
        return names[int(np.argmax(score))]

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [best(text or "") for part in _slices(batch, batch) for text in part.to_pylist()]
            yield pa.array(found, pa.string())

    return F.arrow_udf(predict, "string")


def top1_language(scores: DataFrame, languages: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, predicted): language of the highest score, the first by name on ties."""
    ranked = F.array(*[
        F.struct(F.col(lang).alias("score"), F.lit(-i).alias("rank"), F.lit(lang).alias("lang"))
        for i, lang in enumerate(languages)
    ])
    return scores.select(id_col, F.array_max(ranked)["lang"].alias("predicted"))


def lang_identify(df: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  out_col: str = "predicted", max_cells: int = MAX_MODEL_CELLS) -> DataFrame:
    """Add the language of the highest score, the first by name on ties.

    A model of at most ``max_cells`` numbers travels to the workers, and texts are scored
    where they are, without a shuffle. A larger one is joined by shuffle under a row number of
    its own, so that null and repeated ids are rows like any other. Both give the same languages.
    """
    bases = language_bases(model)
    gains = _gains(model, bases)
    rows = gains.limit(max_cells // max(1, len(bases)) + 1).toArrow()
    if len(rows) * len(bases) <= max_cells:
        return df.withColumn(out_col, _predictor(rows, bases)(_padded_letters(F.col(text_col))))
    # Stored, so that the numbers stay with their rows.
    rows = cut(spread(df.drop(out_col), id_col).withColumn("_row", F.monotonically_increasing_id()))
    scores, languages = lang_scores(rows, model, "_row", text_col)
    found = top1_language(scores, languages, "_row").withColumnRenamed("predicted", out_col)
    return rows.join(found, "_row", "left").drop("_row")


def filter_language(df: DataFrame, lang: Column, whitelist: list[str]) -> DataFrame:
    """Rows whose language is listed; an empty list keeps every row."""
    return df.where(lang.isin(whitelist)) if whitelist else df
