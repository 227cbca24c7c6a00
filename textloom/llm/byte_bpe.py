"""Byte-level BPE: merges folded by Spark's array functions over distinct words."""
from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from textloom.functions.text import let
from textloom.llm.blocks import split, stored
from textloom.llm.subwords import STEP, runs, valid_utf8
from textloom.llm.token_files import id_lists

# Words of the dictionary that every task holds; the most frequent ones. At most so many
# entries and so many bytes of words, which bounds the broadcast for any corpus.
DICTIONARY_WORDS, DICTIONARY_BYTES = 1_000_000, 32 << 20
# Words are ranked by classes of their count, so many to each doubling.
COUNT_CLASSES = 64
# Texts of one block: its distinct words outside the dictionary are encoded once.
BLOCK = 2 << 20
# Longer words (no language has them) are merged with a heap, as a fold takes quadratic time.
FOLD_BYTES = 128

#: The code points that count as white space in the published split pattern,
#: all and without space and line end.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_WHITE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankMap:
    """The rank of every mergeable pair of tokens, as a literal that Spark looks up in O(1).

    A pair (a, b) has the key a * size + b. Row displacement gives each key a slot of
    its own in one literal array: ``slot = (key mod p2 + shift[key mod p1]) mod p2``. The slot
    holds key * size + rank, so that a key that is no pair is told apart.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.size = size = max(ranks.values()) + 1
        if size >= 1 << 20:
            raise ValueError("more than a million tokens do not fit the 63 bits of a slot")
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.p1 = _prime(max(257, len(pairs) // 2))
        self.p2 = _prime(max(3 * len(pairs), size * size // self.p1 + 1, 257))
        rows: dict[int, list[int]] = {}
        for key in pairs:
            rows.setdefault(key % self.p1, []).append(key)
        slots, self.shift = np.full(self.p2, -1, np.int64), np.zeros(self.p1, np.int64)
        draw = np.random.default_rng(0)
        for row in sorted(rows, key=lambda r: -len(rows[r])):
            at = np.array([key % self.p2 for key in rows[row]], np.int64)
            shift = 0
            while (slots[(at + shift) % self.p2] >= 0).any():
                shift = int(draw.integers(self.p2))
            slots[(at + shift) % self.p2] = [key * size + pairs[key] for key in rows[row]]
            self.shift[row] = shift
        self.slots = slots

    def lookup(self, slots: Column, shift: Column) -> Callable[[Column, Column], Column]:
        """A function of two token ids: the rank of their pair, or ``size`` for no pair or no token.

        A slot less its key times size is the rank where the key is the pair's own; any other
        difference is negative or too large, and without its sign bit always too large.
        """
        def at(key: Column) -> Column:
            slot = (key % self.p2 + F.get(shift, (key % self.p1).cast("int"))) % self.p2
            found = (F.get(slots, slot.cast("int")) - key * self.size).bitwiseAND(F.lit(2**63 - 1))
            return F.least(found, F.lit(self.size).cast("bigint"))  # ignores null
        return lambda a, b: let(a * self.size + b, at)


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n ** .5) + 1)):
        n += 1
    return n


def _literal(values: np.ndarray) -> Column:
    """A whole array as one literal: the optimizer folds the parsing of its text."""
    return F.from_json(F.lit(json.dumps(values.tolist())), "array<bigint>")


# One token of the fold's state: the rank of the pair it begins, its place in the word and its id,
# 20 bits each (one more for the rank of no pair). The least number is the leftmost pair of least rank.
_ID = _PLACE = 1 << 20


def fold_merges(word: Column, ranks: RankMap) -> Column:
    """Token ids of a word given as an array of byte values (at most a million).

    The state is one array with a number per token. Each step merges the leftmost pair of
    least rank and looks up the two pairs that it makes new; after the last merge the state
    stays as it is.
    """
    # Bound outside the fold, so that the plan holds each array once.
    return let(_literal(ranks.slots), lambda slots: let(_literal(ranks.shift), lambda shift: _folded(
        word, ranks, ranks.lookup(slots, shift))))


def _folded(word: Column, ranks: RankMap, rank: Callable[[Column, Column], Column]) -> Column:
    none = F.array().cast("array<bigint>")
    ids = F.from_json(F.lit(json.dumps(ranks.bytes)), "array<bigint>")
    last = ranks.size * _PLACE * _ID  # from here on no pair

    def token(state: Column) -> Column:
        return state.bitwiseAND(F.lit(_ID - 1))

    def paired(found: Column, place_and_id: Column) -> Column:
        return found * (_PLACE * _ID) + place_and_id

    def step(state: Column, _: Column) -> Column:
        def merge(least: Column) -> Column:
            new = F.shiftright(least, 40)
            place = least.bitwiseAND(F.lit((_PLACE - 1) * _ID))

            def at(p: Column) -> Column:
                left = F.get(state, p - 2)
                return F.concat(
                    F.slice(state, 1, F.greatest(p - 2, F.lit(0))),
                    F.when(p > 1, F.array(paired(rank(token(left), new), left.bitwiseAND(F.lit(_PLACE * _ID - 1))))).otherwise(none),
                    F.array(paired(rank(new, token(F.get(state, p + 1))), place + new)),
                    F.slice(state, p + 2, F.size(state)),
                )
            return F.when(least >= last, state).otherwise(let(F.array_position(state, least).cast("int"), at))
        return let(F.array_min(state), merge)

    def fold(t: Column) -> Column:
        start = F.transform(t, lambda x, i: paired(rank(x, F.get(t, i + 1)), i.cast("bigint") * _ID + x))
        return F.aggregate(F.sequence(F.lit(2), F.size(t)), start, step, lambda s: F.transform(s, token))

    start = F.transform(word, lambda b: F.get(ids, b.cast("int")))
    return let(start, lambda t: F.when(F.size(t) < 2, t).otherwise(fold(t))).cast("array<int>")


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a very long word, with a heap of pairs and linked neighbours."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def rank(i: int) -> int | None:
        j = after[i]
        return ranks.get(word[i:end[j]]) if j < n else None

    heap = [(r, i, end[i], end[after[i]]) for i in range(n) if (r := rank(i)) is not None]
    heapify(heap)
    while heap:
        _, i, mid, stop = heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or not alive[i] or end[i] != mid or end[j] != stop:
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := rank(k)) is not None:
                heappush(heap, (r, k, end[k], end[after[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = after[i]
    return out


class WordSplitter:
    """Cuts texts at the matches of a split pattern.

    ``chunks`` cuts before each space or white-space run as the pattern does; no match
    crosses such a cut, so the matches inside a distinct chunk are found once.
    """

    def __init__(self, pattern: str):
        self._words = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self._chunks = regex.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

    def chunks(self, text: bytes) -> list[str]:
        return self._chunks.findall(text.decode("utf-8", "replace"))

    def words(self, chunk: bytes) -> list[bytes]:
        return [w.encode() for w in self._words.findall(chunk.decode())]

    def words_of(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the words of all chunks, one chunk after the other; the number of words of each chunk)."""
        plain = pc.match_substring_regex(chunks, "^ [A-Za-z]+$")  # a word as it stands: the common case
        rest, counts = self._cut(chunks.filter(pc.invert(plain)).cast(pa.large_string()))
        mask = plain.to_numpy(zero_copy_only=False)
        sizes = np.ones(len(chunks), np.int64)
        sizes[~mask] = counts
        pool = pa.concat_arrays([chunks.filter(plain).cast(pa.binary()), rest])
        of_plain = np.repeat(mask, sizes)
        order, n = np.empty(len(pool), np.int64), int(mask.sum())
        order[of_plain], order[~of_plain] = np.arange(n), np.arange(n, len(pool))
        return pool.take(pa.array(order)), sizes

    def _cut(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """``words_of`` with one search for the chunks whose only white space is a space or line end before them.

        No match crosses the beginning of such a chunk, so they are put together. Other chunks are searched one by one.
        """
        joined = pc.match_substring_regex(chunks, f"^[ \\n][^ \\n{ODD_WHITE}]+$").to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.utf8_length(chunks.filter(pa.array(joined))).to_numpy().astype(np.int64))
        found = self._words.findall("".join(chunks.filter(pa.array(joined)).to_pylist()))
        reached = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        if joined.any() and not np.isin(ends, reached).all():  # a pattern that leaves something out
            joined, found, reached, ends = np.zeros(len(chunks), bool), [], reached[:0], ends[:0]
        single = [self._words.findall(c) for c in chunks.filter(pa.array(~joined)).to_pylist()]
        sizes = np.empty(len(chunks), np.int64)
        sizes[joined] = np.diff(np.searchsorted(reached, ends, "right"), prepend=0)
        sizes[~joined] = list(map(len, single))
        pool = pa.array([*found, *chain.from_iterable(single)], pa.string()).cast(pa.binary())
        if not single:
            return pool, sizes
        # From the order of the search to that of the chunks.
        first = np.empty(len(chunks), np.int64)
        for part in (joined, ~joined):
            first[part] = np.cumsum(sizes[part]) - sizes[part] + (0 if part is joined else len(found))
        return pool.take(pa.array(runs(first, sizes))), sizes

    def chunk_lists(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of each text, cut in Arrow where white space is single spaces and line ends.

        The byte that marks the cuts is in no UTF-8 text.
        """
        texts = valid_utf8(texts)
        marked = pc.replace_substring(pc.replace_substring(texts.cast(pa.large_binary()), b" ", b"\xff "), b"\n", b"\xff\n")
        odd = pc.match_substring_regex(texts, f"[ \\n][ \\n]|[{ODD_WHITE}]")
        if pc.any(odd).as_py():
            cut = [b"\xff".join(c.encode() for c in self._chunks.findall(t)) for t in texts.filter(odd).to_pylist()]
            marked = pc.replace_with_mask(marked, odd, pa.array(cut, pa.large_binary()))
        return pc.split_pattern(marked, b"\xff")


def _byte_lists(words: pa.BinaryArray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy())])
    begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset] if len(words) else 0
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[begin:begin + offsets[-1]]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(data.astype(np.int16)))


def word_counts(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of at most ``FOLD_BYTES`` bytes occurs, summed over blocks of texts."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = WordSplitter(pattern)
        for batch in batches:
            for block in split(batch, BLOCK):
                pa.default_memory_pool().release_unused()  # what the block before it took
                found = splitter.chunk_lists(block.column("text")).values.value_counts()
                words, sizes = splitter.words_of(found.field("values"))
                coded = words.dictionary_encode()
                n = np.bincount(coded.indices, np.repeat(found.field("counts").to_numpy(), sizes), len(coded.dictionary))
                counted = pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n.astype(np.int64))], ["word", "n"])
                yield counted.filter(pc.less_equal(pc.binary_length(coded.dictionary), FOLD_BYTES))

    given = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return given.mapInArrow(counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counted: DataFrame, words: int) -> DataFrame:
    """(word): the words of the highest classes of counts, as many classes as hold at most ``words`` words.

    Only the sizes of the classes reach the driver, a few thousand numbers for any corpus.
    """
    level = F.floor(F.log2("n") * COUNT_CLASSES)
    least = total = None
    for row in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        total = (total or 0) + row["count"]
        if total > words:
            break
        least = row["level"]
    return counted.where(level >= least if least is not None else F.lit(False)).select("word")


class Dictionary:
    """Encoded words as flat buffers: looked up in Arrow, without an object per word."""

    def __init__(self, table: pa.Table):
        """From (word, ids); the words beyond ``DICTIONARY_BYTES`` are left out."""
        table = table.combine_chunks()
        size = np.cumsum(pc.binary_length(table.column("word")).to_numpy())
        table = table.slice(0, int(np.searchsorted(size, DICTIONARY_BYTES, "right")))
        self.words = pa.concat_arrays([pa.array([], pa.binary()), *table.column("word").chunks])
        ids = table.column("ids")
        self.sizes = pc.list_value_length(ids).to_numpy().astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.ids = pc.list_flatten(ids).to_numpy().astype(np.int32)

    def known(self, words: pa.BinaryArray, others: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each of the distinct words, 0 for unknown ones; the ids of the known ones in a row).

        ``others`` holds the ids of words known without the dictionary, by their place.
        """
        # The few words are searched for the many: a table of the dictionary would be built anew by each call.
        place = pc.index_in(self.words, value_set=words).fill_null(-1).to_numpy()
        at = np.full(len(words), -1, np.int64)
        at[place[place >= 0]] = np.flatnonzero(place >= 0)
        sizes, begins = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        found = at >= 0
        sizes[found], begins[found] = self.sizes[at[found]], self.begins[at[found]]
        pool = self.ids
        if others:
            places, lengths = list(others), np.array(list(map(len, others.values())), np.int64)
            sizes[places], begins[places] = lengths, len(pool) + np.cumsum(lengths) - lengths
            pool = np.concatenate([pool, np.array(list(chain.from_iterable(others.values())), np.int32)])
        return sizes, gathered(pool, begins[sizes > 0], sizes[sizes > 0], np.array([], np.int64))[0]


# One block of texts between its two passes: which words each chunk has and which chunks each text
# has, as positions (int32); ids of words that are known already; bytes of the others.
_CODED = ("id array<{kind}>, texts binary, chunks binary, chunk_words binary, words binary, "
          "sizes binary, known binary, unknown array<array<smallint>>")


def encode_bpe(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    dictionary_words: int = DICTIONARY_WORDS, decoded: str | None = None,
) -> DataFrame:
    """(doc_id, ids): byte-level BPE ids of every whole text, one row per row of ``docs``.

    1. Distinct words are counted; the frequent ones are encoded by ``fold_merges`` and broadcast,
       up to ``dictionary_words`` entries and 32 MB, whatever the corpus.
    2. Each block of texts becomes one row: its distinct words as positions, those outside
       the dictionary as bytes, which the same fold encodes.
    3. Each text takes the ids of its words in order. No text and no occurrence is shuffled.

    With ``decoded`` a column of that name holds the bytes of the ids, as ``decode_bpe`` gives
    them, without a further Python pass.

    A null or empty text has no ids. Bytes that are not UTF-8 count as U+FFFD. Null ids stay
    null, repeated rows give repeated results, an empty table gives no rows, other
    columns are not read.
    """
    spark = docs.sparkSession
    ranks = load_ranks(rank_file)
    rank_map = RankMap(ranks)
    frequent = frequent_words(stored(word_counts(docs, pattern, text_col), "words"), dictionary_words)
    as_bytes = frequent.repartition(spark.sparkContext.defaultParallelism * 2).mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays(
            [b.column(0), _byte_lists(b.column(0))], ["word", "bytes"]) for b in batches),
        "word binary, bytes array<smallint>")
    sent = spark.sparkContext.broadcast(Dictionary(as_bytes.select("word", fold_merges(F.col("bytes"), rank_map).alias("ids")).toArrow()))
    pieces = token_pieces(ranks) if decoded else None
    kind = docs.schema[id_col].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, dictionary = WordSplitter(pattern), sent.value
        for batch in batches:
            for block in split(batch, BLOCK):
                pa.default_memory_pool().release_unused()  # what the block before it took
                lists = splitter.chunk_lists(block.column("text"))
                coded = lists.values.dictionary_encode()
                places, of_chunk = splitter.words_of(coded.dictionary)
                places = places.dictionary_encode()
                words = places.dictionary
                long = np.flatnonzero(pc.binary_length(words).to_numpy() > FOLD_BYTES).tolist()
                sizes, known = dictionary.known(words, {i: merge_long(words[i].as_py(), ranks) for i in long})
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.column("id").to_pylist()], pa.list_(block.column("id").type)),
                    *[pa.array([np.asarray(x, np.int32).tobytes()], pa.binary()) for x in (
                        np.diff(lists.offsets.to_numpy()), coded.indices.to_numpy(), of_chunk, places.indices.to_numpy(), sizes)],
                    pa.array([known.tobytes()], pa.binary()),
                    _one(_byte_lists(words.filter(pa.array(sizes == 0)))),
                ], ["id", "texts", "chunks", "chunk_words", "words", "sizes", "known", "unknown"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pa.default_memory_pool().release_unused()
                texts, chunks, chunk_words, words, sizes, known = (
                    np.frombuffer(batch.column(c)[row].as_py(), np.int32) for c in (
                        "texts", "chunks", "chunk_words", "words", "sizes", "known"))
                folded = batch.column("found")[row].values  # one list of ids per unknown word
                sizes = sizes.astype(np.int64)
                missing = np.flatnonzero(sizes == 0)
                lengths = folded.value_lengths().to_numpy(zero_copy_only=False)
                # Ids of each word: of known ones from the dictionary, of the others from the fold.
                begins = np.cumsum(sizes) - sizes
                begins[missing], sizes[missing] = len(known) + np.cumsum(lengths) - lengths, lengths
                pool = np.concatenate([known, folded.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
                per_chunk, size = gathered(pool, begins[words], sizes[words], chunk_words)
                ids, size = gathered(per_chunk, (np.cumsum(size) - size)[chunks], size[chunks], texts)
                lists = id_lists(ids, np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[row].values, lists, *([joined_pieces(lists, pieces)] if decoded else [])],
                    ["doc_id", "ids", *([decoded] if decoded else [])])

    given = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    blocks = given.mapInArrow(code, _CODED.format(kind=kind))
    folded = blocks.withColumn("found", F.transform("unknown", lambda w: fold_merges(w, rank_map))).drop("unknown")
    return folded.mapInArrow(assemble, f"doc_id {kind}, ids array<int>" + (f", `{decoded}` binary" if decoded else ""))


def gathered(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of the pool one after the other, how much each group of ``groups`` runs holds)."""
    parts = [pool[:0]]
    for at in range(0, len(begins), STEP):
        parts.append(pool[runs(begins[at:at + STEP], sizes[at:at + STEP])])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate(parts), np.diff(ends[np.concatenate([[0], np.cumsum(groups)])])


def _one(lists: pa.ListArray) -> pa.ListArray:
    """The whole array as a single row."""
    return pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists)


def token_pieces(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The bytes of each token id."""
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def joined_pieces(lists: pa.ListArray, tokens: list[bytes | None]) -> pa.Array:
    """The tokens' bytes of each list put together; null for a null list."""
    # The tokens of all rows lie one after the other; only the cuts between rows matter.
    taken = pa.array(tokens, pa.large_binary()).take(lists.flatten())
    if taken.null_count:
        raise ValueError("an id has no token")
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(taken.buffers()[1], np.int64)[:len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    cuts = ends[np.concatenate([[0], np.cumsum(sizes)])]
    whole = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lists), [None, pa.py_buffer(cuts.tobytes()), taken.buffers()[2] or pa.py_buffer(b"")])
    return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def decode_bpe(rows: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids, the tokens' binary pieces put together.

    A null list gives null, an empty one no bytes; ids without a token raise. Repeated rows
    give repeated results, an empty table gives no rows.
    """
    tokens = token_pieces(load_ranks(rank_file))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            whole = joined_pieces(batch.column(batch.schema.names.index(ids)), tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, whole], [*batch.schema.names, out])

    return rows.mapInArrow(batches, StructType([*rows.schema.fields, StructField(out, BinaryType())]))
