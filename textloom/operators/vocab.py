"""Vocabularies, token ids and back."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import blank_words
from textloom.operators.positions import with_position
from textloom.operators.skew import HOT_ROWS, join_per_key
from textloom.operators.spread import spread
from textloom.operators.storage import stored

MAX_IN_MEMORY = 1 << 19  # vocabulary entries that the driver and a worker may hold; larger ones are joined
# Entries of a larger vocabulary that are looked up in the tasks: those with ids below this, which are the most
# frequent words where ids follow ranks. Only the other words of a row are joined.
FREQUENT = 1 << 18
SPECIAL_TOKENS = ["<pad>", "<bos>", "<eos>", "<unk>"]
PAD, BOS, EOS, UNK = 0, 1, 2, 3


def build_vocab(df: DataFrame, text_col: str, size: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(token, id): the four special tokens, then the most frequent words, ties by word.

    ``size`` counts the special tokens too; without it every word gets an id. Ids come
    from positions in a distributed sort, so no task holds the whole vocabulary.
    """
    counts = (
        spread(df.select(id_col, text_col), id_col)
        .select(F.explode_outer(blank_words(F.col(text_col))).alias("token"))
        .where(~F.col("token").isin(SPECIAL_TOKENS))  # also drops the null of an empty text
        .groupBy("token").agg((-F.count("*")).alias("rank"))
    )
    first = len(SPECIAL_TOKENS)
    if size is not None:
        counts = counts.orderBy("rank", "token").limit(size - first)
    # Stored, which removes what the count shuffled.
    words = with_position(stored(counts, "words"), ["rank", "token"], "pos").select("token", (F.col("pos") + first).cast("int").alias("id"))
    special = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).alias("id")) for i, t in enumerate(SPECIAL_TOKENS)]))
    return df.sparkSession.range(1).select(special.alias("s")).select("s.token", "s.id").unionByName(words)


def scan_vocab(df: DataFrame, json_col: str = "value") -> DataFrame:
    """(token, id) from a JSON vocabulary: ``{token: id}`` or ``{"tokens": [...]}``.

    In the list form the id is the position, and a repeated token keeps its last one.
    """
    parsed = df.select(
        F.from_json(json_col, "tokens array<string>")["tokens"].alias("listed"),
        F.from_json(json_col, "map<string,variant>").alias("mapped"),
    )
    listed = (
        parsed.where("listed is not null")
        .select(F.posexplode("listed").alias("id", "token"))
        .groupBy("token").agg(F.max("id").cast("bigint").alias("id"))
    )
    mapped = parsed.where("listed is null").select(F.explode("mapped").alias("token", "value"))
    # Only JSON integers are ids; text such as "5" is not.
    whole = F.when(F.schema_of_variant("value") == "BIGINT", F.try_variant_get("value", "$", "bigint"))
    return listed.unionByName(mapped.select("token", whole.alias("id")))


def vocab_size(vocab: DataFrame) -> DataFrame:
    """One row: greatest id + 1 (0 when empty) and the counts that make it invalid."""
    per_id = vocab.groupBy("id").agg(F.count("*").alias("n"))
    return per_id.agg(
        (F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("size"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("not_integer"),
        F.count_if(F.col("id") < 0).alias("negative"),
        F.count_if((F.col("n") > 1) & F.col("id").isNotNull()).alias("duplicated"),
    )


def check_vocab(vocab: DataFrame) -> int:
    """Size of a valid vocabulary; raises for text, negative or repeated ids."""
    row = vocab_size(vocab).first()
    if row.not_integer or row.negative or row.duplicated:
        raise ValueError(f"invalid vocabulary ids: {row.asDict()}")
    return row.size


def _in_memory(vocab: DataFrame, limit: int) -> pa.Table | None:
    """The vocabulary's (token, id) rows as Arrow, or None when it has more than ``limit`` entries.

    A row without token or id says nothing and is left out. Rows beyond the limit are counted, not fetched.
    """
    known = vocab.where("token is not null and id is not null")
    if known.limit(limit + 1).count() > limit:
        return None
    return known.select("token", F.col("id").cast("bigint").alias("id")).toArrow()


def _id_lookup(table: pa.Table, miss: int) -> Column:
    """Arrow UDF from token lists to id lists; the table is sorted once and searched per batch."""
    table = table.group_by("token").aggregate([("id", "max")]).sort_by("token")
    tokens = table["token"].combine_chunks()
    ids = table["id_max"].combine_chunks().cast(pa.int32())

    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow.compute as pc

        # One index for all batches of a task; words of a batch are looked up once each.
        index = dict(zip(tokens.to_pylist(), ids.to_pylist()))
        for batch in batches:
            lists = batch.cast(pa.list_(pa.string()))
            words = lists.flatten().dictionary_encode()
            found = np.array([index.get(w, miss) for w in words.dictionary.to_pylist()] + [miss], np.int32)
            # A null token is unknown, too: the last entry.
            at = words.indices.fill_null(len(found) - 1).to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(lists)
            offsets = pa.concat_arrays([
                pa.array([0], pa.int32()), pc.cumulative_sum(lengths.fill_null(0)),
            ])
            yield pa.ListArray.from_arrays(offsets, pa.array(found[at]), mask=lengths.is_null())

    return F.arrow_udf(lookup, T.ArrayType(T.IntegerType()))


def _coded(table: pa.Table) -> Column:
    """Arrow UDF from token lists to (ids, words): ids of the table's tokens, and -1 - k for the k-th of the row's other words.

    ``words`` holds each other word of a row once. A null token is read as ``<unk>``.
    """
    tokens, ids = table["token"].combine_chunks(), table["id"].combine_chunks().cast(pa.int32())

    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow.compute as pc

        index = dict(zip(tokens.to_pylist(), ids.to_pylist()))
        for batch in batches:
            lists = batch.cast(pa.list_(pa.string()))
            words = lists.flatten().fill_null("<unk>").dictionary_encode()
            found = np.array([index.get(w, -1) for w in words.dictionary.to_pylist()], np.int32)
            at = words.indices.to_numpy(zero_copy_only=False)
            out = found[at] if len(at) else np.empty(0, np.int32)
            lengths = pc.list_value_length(lists)
            offsets = np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))])
            open_at = np.flatnonzero(out < 0)
            # One number per row and word; in order, the words of a row stand together.
            kinds = max(1, len(found))
            row = np.searchsorted(offsets, open_at, side="right") - 1
            pairs, slot = np.unique(row * kinds + at[open_at], return_inverse=True)
            starts = np.searchsorted(pairs, np.arange(len(lists) + 1) * kinds)
            out[open_at] = -1 - (slot - starts[row])
            others = words.dictionary.take(pa.array(pairs % kinds, pa.int64()))
            yield pa.StructArray.from_arrays([
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out), mask=lengths.is_null()),
                pa.ListArray.from_arrays(pa.array(starts, pa.int32()), others),
            ], ["ids", "words"])

    return F.arrow_udf(code, "struct<ids: array<int>, words: array<string>>")


def token_ids(
    df: DataFrame,
    tokens: Column,
    vocab: DataFrame,
    out_col: str = "ids",
    unk: int = UNK,
    model_size: int | None = None,
    max_in_memory: int = MAX_IN_MEMORY,
    frequent: int = FREQUENT,
    hot_rows: int = HOT_ROWS,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``out_col``: the id of every token, in order, and leave out the columns ``drop``.

    An unknown or null token gets the id of ``<unk>`` in the vocabulary, or ``unk`` without
    one; an id not below ``model_size`` becomes ``unk``. A token that the vocabulary
    repeats has its largest id, and entries without token or id are left out. A
    vocabulary that fits a worker is looked up without moving rows. Of a larger one the entries with
    ids below ``frequent`` are looked up in the tasks; the other words, each once per row, are joined by
    shuffle, those in more than ``hot_rows`` rows by broadcast, and put in their places
    under a row number of their own. Both give the same lists.
    """
    id_of = F.col("id") if model_size is None else F.when(F.col("id") < model_size, F.col("id")).when(F.col("id").isNotNull(), unk)
    clamped = vocab.select("token", id_of.alias("id"), F.col("id").alias("rank"))
    table = _in_memory(clamped, max_in_memory)
    if table is not None:
        marks = table.filter(pa.compute.equal(table["token"], "<unk>"))["id"].to_pylist()
        return df.withColumn(out_col, _id_lookup(table, max(marks, default=unk))(tokens)).drop(*drop)
    known = stored(clamped.where("token is not null and id is not null").groupBy("token").agg(
        F.max("id").alias("id"), F.min("rank").alias("rank")), "known")
    miss = known.where("token = '<unk>'").agg(F.coalesce(F.max("id"), F.lit(unk))).first()[0]
    # A negative id would look like a word that is still to be found.
    near = known.where(F.col("rank").between(0, frequent - 1) & (F.col("id") >= 0)).select("token", "id").limit(frequent).toArrow()
    # Stored, so that the numbers stay with their rows.
    numbered = stored(df.select(
        *[c for c in df.columns if c not in drop], _coded(near)(tokens).alias("_coded"), F.monotonically_increasing_id().alias("_row")), "coded")
    others = numbered.select("_row", F.posexplode("_coded.words").alias("slot", "token"))
    total = numbered.agg(F.coalesce(F.sum(F.size("_coded.words")), F.lit(0))).first()[0]
    per_word = stored(others.groupBy("token").agg(F.count("*").alias("rows")).join(known.drop("rank"), "token", "left").select(
        "token", "rows", F.coalesce("id", F.lit(miss)).cast("int").alias("id")), "per_word")
    found = join_per_key(others, per_word, ["token"], "rows", total, hot_rows).select("_row", "slot", "id")
    lists = found.groupBy("_row").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("slot", "id"))),
        lambda x: x["id"],
    ).alias("_found"))
    placed = F.transform("_ids", lambda i: F.when(i >= 0, i).otherwise(F.get("_found", -1 - i)))
    coded = numbered.withColumn("_ids", F.col("_coded.ids")).drop("_coded")
    return coded.join(lists, "_row", "left").withColumn(out_col, placed).drop("_row", "_ids", "_found")


def vocab_lookup(df: DataFrame, text_col: str, vocab: DataFrame, **options) -> DataFrame:
    """Token ids of the blank-separated words of a text column."""
    return token_ids(df, blank_words(F.col(text_col)), vocab, **options)


def with_given_ids(found: Column, given: Column, model_size: int, unk: int = UNK) -> Column:
    """Looked-up ids with the ids that the input gave itself at their places.

    Given ids not below the model's size become ``unk``; without a list of given ids all
    looked-up ids stay.
    """
    return F.when(given.isNull(), found).otherwise(F.zip_with(found, given, lambda f, g: F.when(
        g.isNull(), f).when((g < model_size) & (g >= 0), g).otherwise(unk)))


def tokenize_vocab(df: DataFrame, text_col: str, vocab: DataFrame, max_length: int = 2048,
                   **options) -> DataFrame:
    """``input_ids``: token ids cut to ``max_length``."""
    out = vocab_lookup(df, text_col, vocab, out_col="input_ids", **options)
    return out.withColumn("input_ids", F.slice("input_ids", 1, max_length))


def token_length_stats(df: DataFrame, ids_col: str, max_length: int) -> DataFrame:
    """One row: texts, tokens, exact median and maximum length, truncated share."""
    n = F.size(ids_col)
    return df.select(n.alias("n")).groupBy("n").agg(F.count("*").alias("texts")).agg(
        F.sum("texts").alias("texts"),
        F.sum(F.col("n") * F.col("texts")).alias("tokens"),
        F.percentile("n", 0.5, F.col("texts")).alias("median_length"),
        F.max("n").alias("max_length"),
        F.round(F.sum(F.when(F.col("n") > max_length, F.col("texts")).otherwise(0))
                / F.sum("texts"), 6).alias("truncated_share"),
    )


def _spoken(table: pa.Table) -> Column:
    """Arrow UDF from id lists, and (id, token) of their ids that the table lacks, to words joined by blanks; null ids are left out."""
    table = table.group_by("id").aggregate([("token", "max")])

    def words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow.compute as pc

        index = dict(zip(table["id"].to_pylist(), table["token_max"].to_pylist()))
        for batch, more in batches:
            lists = batch.cast(pa.list_(pa.int64()))
            pairs = more.flatten()
            here = dict(zip(pairs.field("id").to_pylist(), pairs.field("token").to_pylist()))
            flat = lists.flatten()
            ids = flat.drop_null().dictionary_encode()
            shown = pa.array([
                index[i] if i in index else here.get(i, f"[<UNK>_ID:{i}]") for i in ids.dictionary.to_pylist()], pa.string())
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])
            kept = np.concatenate([[0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))])[ends]
            spoken = pa.LargeListArray.from_arrays(
                pa.array(kept, pa.int64()), shown.cast(pa.large_string()).take(ids.indices), mask=lists.is_null())
            yield pc.binary_join(spoken, pa.scalar(" ", pa.large_string())).cast(pa.string())

    return F.arrow_udf(words, "string")


def detokenize(
    df: DataFrame, ids_col: str, vocab: DataFrame, out_col: str = "text",
    skip: tuple[int, ...] = (PAD, BOS, EOS), max_in_memory: int = MAX_IN_MEMORY,
    frequent: int = FREQUENT, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Words of an id list joined by blanks; special ids skipped, unknown ids shown.

    A vocabulary of at most ``max_in_memory`` entries is looked up in the tasks. Of a larger one
    the ids below ``frequent`` are; the others, each once per row, are joined by shuffle, those in more than
    ``hot_rows`` rows by broadcast. Both give the same text. An id that the vocabulary repeats has its
    last token in sort order.
    """
    kept = F.filter(ids_col, lambda i: ~i.isin(*skip)) if skip else F.col(ids_col)
    table = _in_memory(vocab, max_in_memory)
    if table is None:
        known = stored(vocab.where("token is not null and id is not null").groupBy("id").agg(F.max("token").alias("token")), "known")
        near = known.where(F.col("id").between(0, frequent - 1)).select("token", F.col("id").cast("bigint").alias("id")).toArrow()
        # Stored, so that the numbers stay with their rows.
        numbered = stored(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        far = F.array_distinct(F.filter(kept, lambda i: ~i.between(0, frequent - 1)))
        others = numbered.select("_row", F.explode(far).alias("id"))
        total = numbered.agg(F.coalesce(F.sum(F.size(far)), F.lit(0))).first()[0]
        per_id = stored(others.groupBy("id").agg(F.count("*").alias("rows")).join(known, "id"), "per_id")
        found = join_per_key(others, per_id, ["id"], "rows", total, hot_rows).groupBy("_row").agg(
            F.collect_list(F.struct(F.col("id").cast("bigint").alias("id"), "token")).alias("_found"))
        whole = numbered.join(found, "_row", "left")
        return whole.withColumn(out_col, _spoken(near)(kept, F.col("_found"))).drop("_row", "_found")
    table = table.group_by("id").aggregate([("token", "max")])

    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc

        index = dict(zip(table["id"].to_pylist(), table["token_max"].to_pylist()))
        for batch in batches:
            lists = batch.cast(pa.list_(pa.int64()))
            ids = lists.flatten().dictionary_encode()
            shown = pa.array([index.get(i, f"[<UNK>_ID:{i}]") for i in ids.dictionary.to_pylist()], pa.string())
            ends = pc.cumulative_sum(pc.list_value_length(lists).fill_null(0))
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            spoken = pa.ListArray.from_arrays(offsets, shown.take(ids.indices), mask=lists.is_null())
            yield pc.binary_join(spoken, " ")

    return df.withColumn(out_col, F.arrow_udf(words, "string")(kept))
