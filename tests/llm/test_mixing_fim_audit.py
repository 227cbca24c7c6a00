"""Fill-in-the-middle, source mixing and the filter audit against brute force and on edge cases."""
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import edge_rows
from textloom.llm import queries
from textloom.llm.byte_transducer import CLASS, NEXT, OUT, Spans, measure
from textloom.llm.fill_in_middle import ERROR_BOUND, FimRule, RankIndex, boundaries, fill_in_middle, restored, transform
from textloom.llm.filter_audit import filter_audit
from textloom.llm.source_mixing import MixRule, apportion, mix_sources, mixed_texts, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- fill in the middle --------------------------------------------------------------------

def by_hand(doc_id, text):
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fim_matches_cutting_by_hand(spark, sf, texts):
    rows = queries.op11_learned_rank_index(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, prefix, middle, output = by_hand(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_fim_on_edges(edges, empty):
    made = fill_in_middle(edges).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.back) for r in made) == Counter((i, t or "") for i, t in edge_rows())
    assert all(r.form == "plain" and r.n == 0 for r in made if r.doc_id in (5, 6))
    assert fill_in_middle(empty).count() == 0


def test_marks_in_texts_and_other_marks(spark):
    rows = [(i, t) for i, t in enumerate(["a <P> b", "<<S<M", "x<M>", "<P", ">S><", "[m] [s] é"] * 8)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    rule = FimRule(cut_percent=100, prefix="[p]", suffix="[s]", middle="[m]", seed=5)
    for r in (FimRule(cut_percent=100), rule):
        made = fill_in_middle(docs, r).withColumn("back", restored(F.col("output"), F.col("form"), r)).collect()
        assert {(x.doc_id, x.back) for x in made} == set(rows)
        marks = (r.prefix, r.suffix, r.middle)
        assert all((x.form == "plain") == any(m in rows[x.doc_id][1] for m in marks) for x in made)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_fim_any_texts(texts):
    rows = transform(list(range(len(texts))), [t.encode("utf-8", "replace") for t in texts], FimRule())
    for i, (text, row) in enumerate(zip(texts, rows)):
        n, form, prefix, middle, output = by_hand(i, text.encode("utf-8", "replace").decode())
        assert row == (n, form, prefix, middle, output.encode())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=3000), st.sampled_from([1, 3, ERROR_BOUND]))
def test_rank_index_is_exact_within_its_bound(steps, bound):
    offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
    index = RankIndex(offsets, bound)
    assert (index[np.arange(len(offsets))] == offsets).all()
    assert np.abs(index.residuals.astype(int)).max() <= bound + 1
    assert RankIndex(np.arange(100_000)).firsts.tolist() == [0]


def test_one_segment_covers_long_mixed_texts():
    data = ("abc" * 1000 + "日本語" * 1000 + "é" * 3000).encode()
    offsets = boundaries(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    index = RankIndex(offsets)
    assert len(index.firsts) <= 6 and (index[np.arange(len(offsets))] == offsets).all()


# --- mixing --------------------------------------------------------------------------------

def seats_by_hand(votes, seats, limit):
    quotients = sorted((-v / (2 * k + 1), p, k) for p, v in votes.items() for k in range(seats))
    won = Counter(p for _, p, _ in quotients[:seats])
    return {p: min(won[p], limit[p]) for p in votes}


def test_apportion_is_sainte_lague(spark):
    draw = random.Random(5)
    cases = []
    for g in range(150):
        m = draw.choice([1, 2, 3, 9, 40])
        top = draw.choice([3, 100, 10_000])
        cases.append((g, {p: draw.randint(1, top) for p in range(m)}, draw.choice([0, 1, 2, m // 2, m, 7 * m, 500]), {p: draw.choice([0, 5, 10_000]) for p in range(m)}))
    rows = [(g, p, v, seats, limit[p]) for g, votes, seats, limit in cases for p, v in votes.items()]
    df = spark.createDataFrame(rows, "g int, p int, v bigint, s bigint, most bigint")
    got = {(r.g, r.p): r.won for r in apportion(df, ["g"], ["p"], "v", "s", "most").collect()}
    assert got == {(g, p): n for g, votes, seats, limit in cases for p, n in seats_by_hand(votes, seats, limit).items()}


def targets_by_hand(sizes):
    weight = {k: 1 + i % 3 for i, k in enumerate(sorted(sizes))}
    target, left, open_ = {}, sum(sizes.values()), set(sizes)
    while open_:
        # One division of whole numbers, for equal quotients must be equal.
        share = {k: weight[k] * left / sum(weight[j] for j in open_) for k in open_}
        full = {k for k in open_ if share[k] >= 3 * sizes[k]}
        if not full:
            return target | share
        target |= {k: float(3 * sizes[k]) for k in full}
        left -= sum(3 * sizes[k] for k in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 5}, {"a": 0}, {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 3, "c": 1, "d": 0, "e": 70, "f": 2}, {"a": 1, "b": 1, "c": 4000}])
def test_targets_match_refilling_by_hand(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "key string, source_size bigint")
    got = {r.key: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(targets_by_hand(sizes))


def mixed_by_hand(rows, rule):
    """(doc_id, taken words) of (doc_id, text, source), word by word."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    docs = [(i, len(WORD.findall(t or "")), "2" if s is None else "1" + s, md5(f"{rule.seed}:{'' if i is None else i}")) for i, t, s in rows]
    words = sum(d[1] for d in docs)
    shards = max(1, -(-words // rule.shard_words), -(-len(docs) // rule.shard_rows))
    cells = defaultdict(list)
    for d in docs:
        cells[d[2], int(d[3][:8], 16) % shards].append(d)
    size = {c: sum(d[1] for d in ds) for c, ds in cells.items()}
    blocks = {c: -(-n // rule.block_words) for c, n in size.items()}
    per_source, source_blocks = Counter(), Counter()
    for (k, _), n in size.items():
        per_source[k] += n
    for (k, _), n in blocks.items():
        source_blocks[k] += n
    target = targets_by_hand(per_source)
    seats = seats_by_hand({k: t for k, t in target.items() if t > 0}, round(words / rule.block_words), {k: 3 * b for k, b in source_blocks.items()})
    taken = []
    for k in per_source:
        mine = {c[1]: n for c, n in size.items() if c[0] == k and n}
        won = seats_by_hand(mine, seats.get(k, 0), {s: 3 * blocks[k, s] for s in mine})
        for s in [c[1] for c in cells if c[0] == k]:
            n = max(1, blocks[k, s])
            passes, extra = divmod(won.get(s, 0), n)
            first = int(md5(f"{rule.seed}:{k}:{s}")[:8], 16) % n
            chosen = {j for j in range(n) if ((j + 1) * extra + first) // n > (j * extra + first) // n}
            assert len(chosen) == extra
            at = 0
            for i, count, _, _ in sorted(cells[k, s], key=lambda d: (d[3], d[0] is not None, d[0] or 0, d[1])):
                taken.append((i, passes * count + sum((at + w) // rule.block_words in chosen for w in range(count))))
                at += count
    return taken, target, per_source


@pytest.mark.parametrize("rule", [MixRule(), MixRule(block_words=7, shard_words=5000, seed="x"), MixRule(shard_rows=11)])
def test_mix_matches_taking_word_by_word(spark, sf, rule):
    docs = queries.documents(spark, sf)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want, target, size = mixed_by_hand(rows, rule)
    got = mix_sources(docs, rule).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted(want)
    total = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.size == len(WORD.findall(dict((i, t) for i, t, _ in rows)[r.doc_id] or ""))
        assert r.taken == r.passes * r.size + sum(s.end - s.start for s in r.spans)
        total[r.source] += r.taken
        assert (r.target, r.source_size) == (pytest.approx(target["1" + r.source]), size["1" + r.source])
    if rule == MixRule():
        assert all(abs(total[k[1:]] - t) <= max(.01 * t, rule.block_words) for k, t in target.items())


def test_mix_does_not_depend_on_the_order_of_rows(spark, sf):
    docs = queries.documents(spark, sf)
    runs = [sorted((r.doc_id, r.taken) for r in mix_sources(d).collect()) for d in (docs, docs.orderBy(F.rand(3)).repartition(7))]
    assert runs[0] == runs[1]


def test_mix_on_edges(spark, edges, empty):
    sourced = edges.withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("s"), F.col("doc_id") % 4)))
    got = mix_sources(sourced).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert all(r.taken == r.size == 0 for r in got if r.doc_id in (5, 6, 7))
    rows = [(i, t, "s%d" % (i % 4) if i is not None and i % 4 else None) for i, t in edge_rows()]
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(i), n) for i, n in mixed_by_hand(rows, MixRule())[0])
    assert mix_sources(empty).count() == 0
    blank = mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id int, text string, source string")).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2


def test_mixed_texts_hold_the_words_taken(spark, sf):
    docs = queries.documents(spark, sf)
    mix = mix_sources(docs, MixRule(block_words=50)).cache()
    words = Counter()
    for r in mixed_texts(docs, mix).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == Counter({r.doc_id: r.taken for r in mix.collect() if r.taken})


# --- byte transducer and audit -------------------------------------------------------------

def measures_by_hand(text):
    words = WORD.findall(text)
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text)))


def test_tables_are_a_transducer():
    assert len(CLASS) == 256 and OUT.shape == (2, len(NEXT)) and CLASS.max() < len(NEXT)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab AB\n\t#|é日😀\x1c\x85"), max_size=50), max_size=6))
def test_measures_match_counting_by_hand(texts):
    got = measure([t.encode() for t in texts])
    rows = list(zip(*[got[k].tolist() for k in ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")]))
    assert rows == [measures_by_hand(t) for t in texts]


def test_long_words_and_colliding_hashes():
    words = ["x" * 300 + str(i % 3) for i in range(9)] + ["y" * 130, "y" * 130, "y" * 129, "ab", "abc", "ab"]
    text = " ".join(words).encode()
    assert measure([text, text])["n_distinct"].tolist() == [len(set(words))] * 2
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    spans = Spans(text, ends - [len(w) for w in words], ends, np.zeros(len(words), np.int64))
    assert spans.first_occurrences(np.zeros(len(words), np.uint64)).sum() == len(set(words))


def audit_by_hand(rows, labels):
    """rows of (doc_id, part, text); labels of doc_id to (quality, toxic)."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    docs = []
    for i, part, t in rows:
        words, distinct, capitals, points, symbols = measures_by_hand(t)
        fails = "".join(f for f, bad in zip("ABCDE", (
            words < 200, 100 * distinct < 50 * words, 100 * capitals > 2 * points, symbols > 0, i is not None and i > least[t])) if bad)
        docs.append((part, fails, *labels.get(i, (None, None))))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = mine
            for step, f in enumerate(order, 1):
                removed = [d for d in alive if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                shapley[f] += len(removed)
                out[part, order, step] = [
                    len(alive), len(removed), sum(f in d[1] for d in mine) - len(removed), sum(d[1] == f for d in mine),
                    sum(d[2] == 1 for d in removed), sum(d[3] == 1 for d in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_matches_filtering_by_hand(spark, sf):
    docs = queries.documents(spark, sf).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source").substr(1, 4)))
    rows = [(r.doc_id, r.source or "", r.text or "") for r in docs.collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    marks = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    got = filter_audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in got} == audit_by_hand(rows, marks)
    assert len(got) == 600 * len({r[1] for r in rows})


def test_audit_on_edges(spark, edges, empty):
    parts = edges.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("even")))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (6, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    marks = {1: (1, 1), 6: (None, 1)}
    rows = [(i, "even" if i is not None and i % 2 == 0 else "", t or "") for i, t in edge_rows()]
    got = filter_audit(parts, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in got} == audit_by_hand(rows, marks)
    assert filter_audit(empty, labels).count() == 0 and filter_audit(parts, labels.limit(0)).count() == 1200
