"""Subword ids of whole texts, encoding every distinct chunk between spaces once per task."""
from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Chunks a Python worker remembers. Later ones are kept only for their own block of texts.
REMEMBERED = 600_000
# Chunks given to the library in one string: it takes as long for a string as for some words.
TOGETHER = 32
# Strings of words, and other chunks, given to the library at a time: what it returns takes much more memory than the ids.
STRINGS, SINGLY = 100, 1 << 10
# Larger blocks than elsewhere, as a block encodes its rare words once.
BLOCK = 16 << 20


# Occurrences whose ids are put together at a time, which bounds the memory for positions.
STEP = 1 << 18


class SubwordEncoder:
    """Encodes texts with a tokenizer file whose tokens never reach across white space.

    Such tokenizers (white space is dropped before words are split) give a text the ids of
    its chunks between spaces and line ends, one after the other; a chunk is therefore
    encoded once and then looked up. Texts that hold the string of an added token are
    given to the library whole, which finds these tokens first; with ``special_as_text``
    such strings are ordinary text.
    """

    def __init__(self, path: str, end_id: int | None = None, remembered: int = REMEMBERED, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        # Added tokens, in lower case where the library looks for them in normalised text.
        added = [] if special_as_text else list(self._tokenizer.get_added_tokens_decoder().values())
        self._added = [a.content for a in added]
        self._folded = any(a.normalized for a in added)
        self._prefix = os.path.commonprefix(self._added).encode()
        self._path, self._whole = path, None  # for texts with added tokens: read once there is one
        self._end = end_id
        # Remembered chunks, and where the ids of each begin and end in the pool.
        self._known = pa.array([""], pa.large_string())
        self._pool, self._begins, self._sizes = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self._remembered = remembered
        # Tokens that end a word.
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        if suffix:
            self._ends[[i for t, i in self._tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text starts); an end id closes each text."""
        texts = valid_utf8(texts)
        marked = self._with_added_tokens(texts)
        if not len(marked):
            return self._encode(texts)
        self._whole = self._whole or Tokenizer.from_file(self._path)
        flat, starts = self._encode(pc.if_else(pa.array(np.isin(np.arange(len(texts)), marked)), "", texts))
        parts = np.split(flat, starts[1:-1])
        for i in marked:
            ids = self._whole.encode(texts[i].as_py(), add_special_tokens=False).ids
            parts[i] = np.array(ids + ([] if self._end is None else [self._end]), flat.dtype)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _with_added_tokens(self, texts: pa.Array) -> np.ndarray:
        """The texts that hold the string of an added token; mostly one search over all bytes finds none."""
        buffer = texts.buffers()[2]
        if not self._added or buffer is None or (not self._folded and memoryview(buffer).tobytes().find(self._prefix) < 0):
            return np.empty(0, np.int64)
        found = np.zeros(len(texts), bool)
        for token in self._added:
            found |= pc.match_substring(texts, token, ignore_case=self._folded).to_numpy(zero_copy_only=False)
        return np.flatnonzero(found)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(_simpler(texts), " ")
        coded = lists.values.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self._known)
        new = coded.dictionary.filter(place.is_null())
        pool, begins, sizes = self._pool, self._begins, self._sizes
        if len(new):
            ids, size = self._encode_chunks(new.to_pylist())
            pool = np.concatenate([pool, ids])
            begins = np.concatenate([begins, len(self._pool) + np.cumsum(size) - size])
            sizes = np.concatenate([sizes, size])
            place = place.to_numpy(zero_copy_only=False)
            place[np.isnan(place)] = len(self._known) + np.arange(len(new))
            place = place.astype(np.int64)
            if len(self._known) < self._remembered:
                self._known = pa.concat_arrays([self._known, new])
                self._pool, self._begins, self._sizes = pool, begins, sizes
        else:
            place = place.to_numpy(zero_copy_only=False)
        at = place[coded.indices.to_numpy()]
        # Ids of every occurrence: a run of the pool for each chunk, and the end id after each text.
        flat = np.concatenate([pool[:0]] + [
            pool[runs(begins[part], sizes[part])] for part in np.array_split(at, len(at) // STEP + 1)])
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        starts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if self._end is not None:
            flat = np.insert(flat, starts[1:], self._end)
            starts = starts + np.arange(len(starts))
        return flat, starts

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has). A word of letters ends with the first token
        that ends a word, so such words are encoded together."""
        letters = np.fromiter(map(str.isalpha, chunks), bool, len(chunks)) & self._ends.any()
        words, alone = np.flatnonzero(letters).tolist(), np.flatnonzero(~letters).tolist()
        sizes, order, pool = np.zeros(len(chunks), np.int64), [], [np.empty(0, np.uint32)]
        for start in range(0, len(words), TOGETHER * STRINGS):
            part = words[start:start + TOGETHER * STRINGS]
            joined = [" ".join([chunks[k] for k in part[i:i + TOGETHER]]) for i in range(0, len(part), TOGETHER)]
            found = self._tokenizer.encode_batch(joined, add_special_tokens=False)
            flat = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
            ends = np.flatnonzero(self._ends[flat]) + 1
            if len(ends) != len(part):  # a letter unknown to the library: one by one
                alone += part
                continue
            sizes[part] = np.diff(ends, prepend=0)
            order += part
            pool.append(flat)
        for start in range(0, len(alone), SINGLY):
            part = alone[start:start + SINGLY]
            found = [e.ids for e in self._tokenizer.encode_batch([chunks[k] for k in part], add_special_tokens=False)]
            sizes[part] = list(map(len, found))
            order += part
            pool.append(np.fromiter(chain.from_iterable(found), np.uint32))
        # From the order of encoding to that of the chunks.
        begins = np.zeros(len(sizes), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(pool)[runs(begins, sizes)], sizes


def runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all runs that begin at ``begins``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _simpler(texts: pa.Array) -> pa.Array:
    """Texts with the same ids and fewer distinct chunks: a space before marks that follow a
    letter, as they are a word of their own, and small ASCII letters, unless a letter could
    combine with an accent after it (U+0300 to U+037F, whose first byte is 0xCC or 0xCD)."""
    texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), r"(\pL)([!-&(-/:-@\[-`{-~])", r"\1 \2")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return texts if ((data == 0xCC) | (data == 0xCD)).any() else pc.ascii_lower(texts)


def valid_utf8(texts: pa.Array) -> pa.Array:
    """Binary texts as strings; bytes that are not UTF-8 become U+FFFD."""
    try:
        return texts.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())


_ENCODERS: dict[tuple, SubwordEncoder] = {}


def encoder(path: str, end_id: int | None = None) -> SubwordEncoder:
    """The encoder of a file, one per Python worker."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = SubwordEncoder(path, end_id)
    return _ENCODERS[path, end_id]
