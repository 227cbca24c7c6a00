import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import minhash as M
from textloom.operators import dedup as D
from textloom.operators.graph import connected_components


def components_by_hand(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {x: root(x) for x in parent}


def components(spark, edges, **options):
    df = spark.createDataFrame(edges, "src long, dst long")
    return {r.node: r.component for r in connected_components(df, **options).collect()}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=60))
def test_components_match_union_find(spark, edges):
    assert components(spark, edges) == components_by_hand(edges)


def test_components_of_chain_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = components(spark, chain + star, hot_rows=20)
    assert got == components_by_hand(chain + star)
    assert components(spark, [(5, 5)]) == {}


def test_components_refuse_to_stop_early(spark):
    with pytest.raises(RuntimeError):
        components(spark, [(i, i + 1) for i in range(200)], max_rounds=1)


def test_signature_by_hand():
    a, b = M.coefficients(16)
    words = [["x", "y", "zebra"], ["x"], [], ["y"] * 3]
    got = M.signatures(pa.array(words, pa.list_(pa.string())), a, b)
    for row, listed in zip(got.tolist(), words):
        hashes = [M.word_hash(w) for w in listed]
        want = [
            min([((int(x) * h + int(y)) % 2**64 % M.PRIME) & M.MASK for h in hashes], default=M.MASK)
            for x, y in zip(a, b)
        ]
        assert row == want


def test_long_text_is_hashed_in_blocks(monkeypatch):
    a, b = M.coefficients(8)
    words = pa.array([[f"w{i}" for i in range(500)], ["q"], [f"v{i}" for i in range(77)]], pa.list_(pa.string()))
    whole = M.signatures(words, a, b)
    monkeypatch.setattr(M, "WORDS_PER_BLOCK", 13)
    assert np.array_equal(M.signatures(words, a, b), whole)


def test_null_shingles_have_no_signature(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None), (3, [])], "i int, s array<string>")
    got = {r.i: r.x for r in df.select("i", M.minhash_signature(F.col("s"), 4).alias("x")).collect()}
    assert got[2] is None and got[3] is None and len(got[1]) == 4


def test_band_layout():
    assert M.band_layout(0.8, 128) == (9, 13)
    with pytest.raises(ValueError):
        D.layout(0.8, 128, 64, 4)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(60)]
    rows = list(base) + base[:20] + [base[0]] * 40 + ["", " ", "!!"]
    rows += [t.replace(t.split()[3], "changed", 1) for t in base[20:40]]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


def kept(spark, rows, parts=4, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r.doc_id for r in D.dedup_documents(df, **options).collect()}


def test_dedup_does_not_depend_on_partitions_or_order(spark):
    rows = corpus()
    first = kept(spark, rows, 1)
    assert first == kept(spark, rows[::-1], 13, hot_rows=2)
    texts = dict(rows)
    assert kept(spark, [(i, texts[i]) for i in first]) == first  # a second run drops nothing


def test_exact_copies_leave_the_least_id(spark):
    rows = [(i, "one two three") for i in range(1000)] + [(5000, "other words here"), (5001, None), (5002, None)]
    assert kept(spark, rows, 7, hot_rows=50) == {0, 5000, 5001, 5002}


def test_chain_of_copies_is_one_component(spark):
    words = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(words[i:i + 250])) for i in range(0, 50)]
    found = D.Duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=32)
    clusters = {r.id: r.component for r in found.clusters().collect()}
    assert set(clusters.values()) == {0} and len(clusters) == 50


def test_verification_drops_unlike_members(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    loose = D.Duplicates(df, bands=128, rows=1)
    strict = D.Duplicates(df, bands=128, rows=1, verify=True)
    assert loose.kept().count() == 1
    assert {r.doc_id for r in strict.kept().collect()} == {1, 3}
    found = {(r.src, r.dst): r.jaccard for r in D.edge_similarity(loose.edges, df).collect()}
    assert found == {(1, 3): 0.5}


def test_stats_add_up(spark):
    found = D.Duplicates(spark.createDataFrame(corpus(), "doc_id long, text string"))
    row = D.dedup_stats(found).first()
    assert row.kept == found.kept().count() and row.documents - row.dropped == row.kept
