"""Token files, packing and byte-level BPE against the libraries they follow."""
import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import edge_rows
from textloom.llm import byte_bpe, packing, queries, subwords
from textloom.llm.byte_bpe import (
    Dictionary, RankMap, WordSplitter, decode_bpe, encode_bpe, fold_merges, frequent_words, load_ranks, merge_long, word_counts,
)
from textloom.llm.packing import Packer, PackLimits, id_array, pack_documents
from textloom.llm.subwords import SubwordEncoder
from textloom.llm.token_files import file_positions, read_token_files, write_token_files

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(RANKS)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- subwords and token files --------------------------------------------------------------

@pytest.fixture(scope="module")
def encoders():
    """Per switch: the library as it is or with marks as text, and encoders that remember 0 to 3 chunks."""
    out = {}
    for as_text in (False, True):
        t = Tokenizer.from_file(WORDS)
        if as_text:
            t.encode_special_tokens = True
        out[as_text] = t, [SubwordEncoder(WORDS, None, n, special_as_text=as_text) for n in range(4)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.integers(0, 3), st.booleans(), st.sampled_from(["", " <|endoftext|>", "<|startoftext|>x", "<|ENDOFTEXT|>", "<|"]))
def test_chunks_give_the_ids_of_whole_texts(encoders, text, remembered, as_text, mark):
    library, own = encoders[as_text]
    text = (text + mark).encode("utf-8", "replace")
    flat, starts = own[remembered].encode(pa.array([b"", text, b"x"]))
    assert flat[starts[1]:starts[2]].tolist() == library.encode(text.decode(), add_special_tokens=False).ids
    assert flat[starts[2]:starts[3]].tolist() == library.encode("x", add_special_tokens=False).ids


def test_token_files_round_trip(spark, edges, library, tmp_path):
    path = str(tmp_path / "tokens")
    write_token_files(edges, path, WORDS, 2)
    want = sorted((repr(i), library(t).tolist()) for i, t in edge_rows())
    assert sorted((repr(r.doc_id), r.ids) for r in read_token_files(spark, path).collect()) == want
    rows = file_positions(spark, path).orderBy("start").collect()
    assert sum(r.n_tokens for r in rows) == rows[-1].start + rows[-1].n_tokens
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    ids = [r.doc_id for r in rows]
    assert [i for i in ids if i is not None] == sorted(i for i, _ in edge_rows() if i is not None)
    pruned = read_token_files(spark, path, [13, 999])
    assert [r.doc_id for r in pruned.collect()] == [13]
    assert "PushedFilters: [In(doc_id, [13,999])]" in pruned._jdf.queryExecution().toString()


def test_token_files_of_an_empty_table(spark, empty, tmp_path):
    path = str(tmp_path / "none")
    write_token_files(empty, path, WORDS, 2)
    assert file_positions(spark, path).count() == 0


def test_token_query(spark, sf, texts, library):
    start, want = 0, {}
    for i in sorted(texts):
        ids = library(texts[i])
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_orc(spark, sf).collect()}
    assert got == want


# --- packing -------------------------------------------------------------------------------

def check_sequences(rows, limits, loss=None):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert len(pieces) == 1 or sum(r.length for r in pieces) <= limits.tokens
        assert len(pieces) <= limits.segments
    return by


@pytest.mark.parametrize("limits", [PackLimits(), PackLimits(256, 4, 200), PackLimits(4096, 2, 4096)])
def test_pieces_cover_every_id_once(edges, library, limits):
    rows = pack_documents(edges, WORDS, 2, limits).collect()
    by = check_sequences(rows, limits)
    whole = Counter((i, library(t).tobytes()) for i, t in edge_rows())
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        assert 0 < r.length == len(r.ids) // 4 and r.start + r.length <= r.doc_tokens
        assert sum(x.length for x in by[r.sequence_id]) <= min(limits.tokens, limits.loss)
    for i, ids in whole:
        if whole[i, ids] == 1 and [k for k in whole if k[0] == i] == [(i, ids)]:
            parts = sorted(pieces[i, len(ids) // 4], key=lambda r: r.start)
            assert b"".join(bytes(p.ids) for p in parts) == ids
    assert sum(r.length for r in rows) == sum(len(library(t)) for _, t in edge_rows())


def test_ids_as_arrays(spark):
    values = [[], [1], [0, 49407, 2, 65536, 2**31 - 1]]
    df = spark.createDataFrame([(v, np.array(v, "<u4").tobytes()) for v in values], "v array<int>, b binary")
    assert all(r.v == r.a for r in df.select("v", id_array(F.col("b")).alias("a")).collect())


def test_packing_leaves_little_room(spark, sf):
    rows = queries.op4_vector_packing(spark, sf).collect()
    used = sum(r.length for r in rows)
    assert used > .97 * 4096 * len({r.sequence_id for r in rows})


def test_whole_examples_with_loss(spark):
    docs = spark.createDataFrame([(i, "w " * (40 + 7 * i % 60), 5 + i % 30) for i in range(200)], "doc_id bigint, text string, answer bigint")
    limits = PackLimits(300, 5, 60)
    rows = pack_documents(docs, WORDS, 2, limits, cut=False, loss_col="answer", repacked=2).collect()
    by = check_sequences(rows, limits)
    assert len(rows) == 200 and all(r.start == 0 and r.length == r.doc_tokens for r in rows)
    assert all(sum(r.loss for r in p) <= 60 for p in by.values())


def test_packing_nothing(empty):
    assert pack_documents(empty, WORDS, 2).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), max_size=30), st.booleans())
def test_packer(items, cut):
    limits = PackLimits(20, 3, 12)
    tokens = np.array([a for a, _ in items], np.int64)
    loss = np.array([min(a, b) for a, b in items], np.int64)
    packer = Packer(limits, cut)
    placed = [*packer.pack(tokens, loss), *packer.close()]
    covered = defaultdict(list)
    by = defaultdict(list)
    for i, start, length, sequence, offset in placed:
        covered[i].append((start, length))
        by[sequence].append((offset, length, max(0, start + length - max(start, int(tokens[i] - loss[i])))))
    for i, n in enumerate(tokens):
        at = 0
        for start, length in sorted(covered[i]):
            assert start == at and length > 0
            at += length
        assert at == n
    for parts in by.values():
        alone = len(parts) == 1 and not cut
        assert alone or (sum(p[1] for p in parts) <= 20 and sum(p[2] for p in parts) <= 12)
        assert len(parts) <= 3


def test_blocks_are_encoded_in_slices(monkeypatch):
    texts = [(t or "").encode() for _, t in edge_rows()] + [b"12,5 x9 -- <a>" * 20] * 9
    block = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    whole = SubwordEncoder(WORDS, 2).encode(block.column("text"))
    own, given = SubwordEncoder(WORDS, 2), []
    monkeypatch.setattr(packing, "SLICE", 500)
    monkeypatch.setattr(subwords, "SINGLY", 3)
    encode, inner = own.encode, own._tokenizer
    own.encode = lambda part: given.append(part.to_pylist()) or encode(part)

    class Library:
        def encode_batch(self, chunks, **options):
            assert len(chunks) <= max(3, subwords.TOGETHER * 1000)
            if not all(c.replace(" ", "").isalpha() for c in chunks):
                assert len(chunks) <= 3
            return inner.encode_batch(chunks, **options)

    own._tokenizer = Library()
    flat, starts = packing.encoded(own, block)
    assert flat.tolist() == whole[0].tolist() and starts.tolist() == whole[1].tolist()
    assert len(given) > 5 and all(sum(map(len, g[:-1])) < 500 for g in given)


def test_the_library_gets_few_chunks_at_a_time(library):
    letters = "abcdefghijklmnop"
    words = [letters[i % 16] + letters[i // 16 % 16] + letters[i // 256 % 16] + letters[i // 4096] * 3 for i in range(7000)]
    texts = [" ".join(words), " ".join(f"{w}{i}" for i, w in enumerate(words[:3000]))]
    own, given = SubwordEncoder(WORDS, 2), []
    inner = own._tokenizer

    class Library:
        def encode_batch(self, chunks, **options):
            given.append(chunks)
            return inner.encode_batch(chunks, **options)

    own._tokenizer = Library()
    flat, starts = own.encode(pa.array([t.encode() for t in texts], pa.binary()))
    for text, ids in zip(texts, np.split(flat, starts[1:-1])):
        assert ids.tolist() == library(text).tolist()
    # The results of one call are many times larger than the ids.
    assert sum(len(c) for calls in given for c in calls) >= 7000 * 6
    assert max(sum(len(c.split()) for c in chunks) for chunks in given) <= 3200
    assert own._whole is None  # the second copy of the library is only for texts with added tokens


# --- byte-level BPE ------------------------------------------------------------------------

def test_ids_and_decoded_texts(edges, reference):
    want = Counter((i, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in edge_rows())
    for dictionary in (100_000, 5):
        rows = decode_bpe(encode_bpe(edges, RANKS, P.PATTERN, dictionary_words=dictionary), RANKS).collect()
        assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == want


def test_bpe_query(spark, sf, texts, reference):
    for r in queries.op10_byte_bpe(spark, sf).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_decoded_beside_the_ids(spark):
    docs = spark.createDataFrame([(1, "some text"), (1, "some text"), (None, ""), (2, None), (3, "a" * 300)], "doc_id long, text string")
    rows = decode_bpe(encode_bpe(docs, RANKS, P.PATTERN, decoded="both"), RANKS, out="again").collect()
    assert len(rows) == 5 and all(r.both == r.again for r in rows)
    assert sorted(bytes(r.both).decode() for r in rows) == sorted(r.text or "" for r in docs.collect())


def test_frequent_words_by_classes_of_counts(spark):
    docs = spark.createDataFrame([(1, " b b b c c d e"), (2, " b c f")], "doc_id long, text string")
    counted = word_counts(docs, P.PATTERN)
    assert {bytes(r.word): r.n for r in counted.collect()} == {b" b": 4, b" c": 3, b" d": 1, b" e": 1, b" f": 1}
    for limit, found in ((0, 0), (1, 1), (2, 2), (4, 2), (5, 5)):
        assert frequent_words(counted, limit).count() == found


def test_bpe_of_an_empty_table(empty):
    assert decode_bpe(encode_bpe(empty, RANKS, P.PATTERN), RANKS).count() == 0


def test_folded_merges_of_single_words(spark, ranks, reference):
    words = [b"", b"a", b" the", b"aaaaaaaaaaaaa", "éàü".encode(), b"abababab", bytes(range(256))[100:140], b"strawberry"]
    df = spark.createDataFrame([(list(w),) for w in words], "w array<int>").repartition(1)
    got = {tuple(r.w): r.ids for r in df.select("w", fold_merges(F.col("w"), RankMap(ranks)).alias("ids")).collect()}
    for w in words:
        want = reference._core_bpe.encode_single_piece(w) if w else []
        assert got[tuple(w)] == want


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=60), st.text("ab e", min_size=1, max_size=60).map(str.encode)))
def test_heap_merges(word):
    test = test_heap_merges
    if not hasattr(test, "ranks"):
        test.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        test.enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=test.ranks, special_tokens={})
    assert merge_long(word, test.ranks) == test.enc._core_bpe.encode_single_piece(word)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é1.,'s \n\t 　 \x1c!", max_size=40))
def test_chunks_keep_matches(text):
    import regex
    splitter = WordSplitter(P.PATTERN)
    whole = splitter._words.findall(text)
    assert [w.decode() for c in splitter.chunks(text.encode()) for w in splitter.words(c.encode())] == whole
    listed = splitter.chunk_lists(pa.array([b"x  y", text.encode(), b"", b"a b\nc"])).to_pylist()
    assert [w.decode() for c in listed[1] for w in splitter.words(c)] == whole
    if "\x1c" not in text:
        assert whole == regex.findall(P.PATTERN, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é1.,'s \n\t 　 \x1c!", max_size=40), max_size=5), st.sampled_from([P.PATTERN, r" ?\p{L}+|\p{N}"]))
def test_words_of_many_chunks(texts, pattern):
    splitter = WordSplitter(pattern)
    chunks = splitter.chunk_lists(pa.array([t.encode() for t in texts], pa.binary())).values
    words, sizes = splitter.words_of(chunks)
    want = [splitter.words(c) for c in chunks.to_pylist()]
    assert words.to_pylist() == [w for c in want for w in c] and sizes.tolist() == list(map(len, want))


def test_one_search_for_many_chunks():
    splitter, calls = WordSplitter(P.PATTERN), []

    class Search:
        def findall(self, text):
            calls.append(text)
            return found(text)

    found, splitter._words = splitter._words.findall, Search()
    chunks = [b"first", *(f" w{i},".encode() for i in range(1000)), b"\nline", "\u3000".encode(), b" plain"]
    words, sizes = splitter.words_of(pa.array(chunks, pa.large_binary()))
    assert b"".join(words.to_pylist()) == b"".join(chunks) and sizes.tolist() == [1] + [3] * 1000 + [2, 1, 1]
    assert len(calls) == 3


def test_dictionary_is_no_table_of_each_block(monkeypatch):
    own = Dictionary(pa.table({"word": pa.array([b"%d" % i for i in range(1000)], pa.binary()), "ids": [[i, i] for i in range(1000)]}))
    sizes, search = [], byte_bpe.pc.index_in
    monkeypatch.setattr(byte_bpe.pc, "index_in", lambda values, value_set: sizes.append(len(value_set)) or search(values, value_set=value_set))
    found, ids = own.known(pa.array([b"7", b"x", b"999", b"y", b"0"], pa.binary()), {3: [5, 6, 7]})
    assert found.tolist() == [2, 0, 2, 3, 2] and ids.tolist() == [7, 7, 999, 999, 5, 6, 7, 0, 0] and max(sizes) == 5
