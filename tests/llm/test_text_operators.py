"""Operators against brute force: rules, exact and substring dedup, lines, Jaccard groups."""
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import edge_rows, words
from textloom.llm import queries
from textloom.llm.exact_dedup import exact_groups
from textloom.llm.hashing import window_hashes
from textloom.llm.heavy import _summary, frequent_values, with_group
from textloom.llm import jaccard
from textloom.llm.jaccard import JaccardRule, choose_boundary, common_members, jaccard_components, jaccard_join, odd_sketch, sketch_distance
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.repetition import measure, repetition_rules
from textloom.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(rows):
    return Counter(rows)


# --- quality rules -------------------------------------------------------------------------

def rules_by_hand(text):
    words = WORD.findall(text)

    def in_repeats(n):
        runs = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
        hit = [False] * len(words)
        for i in range(len(words) - n + 1):
            if runs[tuple(words[i:i + n])] > 1:
                hit[i:i + n] = [True] * n
        return hit

    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    chars = sum(map(len, words))
    shares = [sum(len(w) for w, h in zip(words, in_repeats(n)) if h) / max(chars, 1) for n in range(5, 11)]
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, sum(in_repeats(5))), shares


def test_rules_match_counting_by_hand(spark, sf, texts):
    for row in queries.op6_repetition_coverage(spark, sf).collect():
        base, shares = rules_by_hand(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == base
        assert row.run_chars == pytest.approx(shares)
        assert row.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (row.kept and row.base_failed)


def test_rules_on_edges(edges, empty):
    rows = repetition_rules(edges).collect()
    assert len(rows) == len(edge_rows())
    by = {r.doc_id: r for r in rows}
    assert by[6].n_words == by[5].n_words == by[7].n_words == 0 and by[6].base_failed and not by[6].kept
    assert by[11].n_words == 30_000 and by[14].base_failed and not by[14].kept
    assert repetition_rules(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab #|\n\té", max_size=80))
def test_measure_any_text(text):
    got = measure([text.encode(), b"", b"x"], [5, 6, 7, 8, 9, 10])
    base, shares = rules_by_hand(text)
    assert tuple(int(got[k][0]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
    assert list(got["run_chars"][0]) == pytest.approx(shares)


def test_window_hashes_tell_windows_apart():
    values = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    got = window_hashes(values, 3)
    assert got[0] == got[3] and len(set(got.tolist())) == 4
    assert len(window_hashes(values, 8)) == 0


# --- exact duplicates ----------------------------------------------------------------------

@pytest.mark.parametrize("counters", [2, 4096])
def test_exact_groups(edges, counters):
    groups = defaultdict(list)
    for i, t in edge_rows():
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in exact_groups(edges, counters=counters).collect())
    assert got == want


def test_exact_groups_empty(empty):
    assert exact_groups(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=30), max_size=5), st.integers(1, 5))
def test_summaries_keep_every_frequent_value(parts, counters):
    merged = [np.empty(0, np.int64), np.empty(0, np.int64)]
    for part in parts:
        one = _summary(np.array(part, np.int64), np.ones(len(part), np.int64), counters)
        merged = _summary(np.concatenate([merged[0], one[0]]), np.concatenate([merged[1], one[1]]), counters)
    total = Counter(x for p in parts for x in p)
    n = sum(total.values())
    assert len(merged[0]) <= counters
    assert {v for v, c in total.items() if c > n / (counters + 1)} <= set(merged[0].tolist())


def test_frequent_values_and_groups(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 7L ELSE id END AS k", "id AS v").repartition(7)
    assert 7 in [r.value for r in frequent_values(rows, "k", 4).collect()]
    got = with_group(rows, "k", {}, smallest=2, counters=4).collect()
    assert len(got) == 1000 and {r.n for r in got} == {1000}


# --- lines ---------------------------------------------------------------------------------

def lines_by_hand(rows):
    """First occurrences in order of (id, text hash is irrelevant here: ids are unique)."""
    first, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            three = tuple(lines[p:p + 3])
            if not "".join(three).strip(" \t\r"):
                continue
            if three in first:
                gone |= {p, p + 1, p + 2}
            first.add(three)
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone))
    return out


def test_lines_match_by_hand(edges):
    plain = [(i, t) for i, t in edge_rows() if i is not None and t is not None and i not in (17, 18)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(
        edges.where("doc_id is not null and text is not null and doc_id not in (17, 18)"), lines_col="n_lines", removed_col="n_removed").collect()}
    assert got == lines_by_hand(plain)
    assert got[16][2] == 0 and got[15][2] == 3


def test_lines_keep_rows_and_columns(edges, empty):
    out = dedup_lines(edges, hot_windows=1)
    assert out.columns == edges.columns and out.count() == len(edge_rows())
    assert {r.id for r in out.select("id").collect()} == {"clash"}
    assert out.where("doc_id = 6 and text is null").count() == 1
    assert dedup_lines(empty).count() == 0


# --- substrings ----------------------------------------------------------------------------

def repeats_by_hand(rows, n):
    words = [WORD.findall(t or "") for _, t in rows]
    runs = Counter(tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1))
    out = Counter()
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if runs[tuple(w[p:p + n])] > 1:
                gone[p:p + n] = [True] * n
        out[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("n", [35, 12])
def test_repeats_match_by_hand(edges, n):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept.decode()) for r in remove_repeats(edges, n).collect())
    assert got == repeats_by_hand(edge_rows(), n)


def test_repeats_query(spark, sf, texts):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_seed_and_extend(spark, sf).collect())
    want = Counter((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in repeats_by_hand(list(texts.items()), 35))
    assert got == want


def test_repeats_empty(empty):
    assert remove_repeats(empty).count() == 0


# --- Jaccard groups ------------------------------------------------------------------------

def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def groups_by_hand(rows, rule):
    sets = [(i, shingles(t, rule.words)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= rule.percent * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("boundary", [None, 0, 60])
def test_groups_match_by_hand(edges, boundary):
    rule = JaccardRule(3, 90)
    got = jaccard_components(edges, rule, boundary=boundary).collect()
    want = groups_by_hand(edge_rows(), rule)
    assert len(got) == len(edge_rows())
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
    sizes = Counter((i, len(shingles(t, 3))) for i, t in edge_rows())
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes


def test_groups_of_near_copies_without_and_with_rounds(spark):
    """A hub with spokes that do not link with each other, a chain, and small sets."""
    base = [f"b{i}" for i in range(200)]
    rows = [(5, " ".join(base))]
    for k in range(40):  # each differs from the hub in 7 shingles of 198, and from the others in about 14
        spoke = list(base)
        spoke[5 * k] = f"s{k}"
        spoke[(5 * k + 90) % 200] = f"t{k}"
        rows.append((100 + k, " ".join(spoke)))
    rows += [(300 + k, " ".join(f"c{i}" for i in range(k * 2, k * 2 + 80))) for k in range(20)]
    rows += [(400 + k, " ".join([f"d{i}" for i in range(12)] + [f"e{k}"] * (k % 2))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    rule = JaccardRule(3, 90)
    want = groups_by_hand(rows, rule)
    for rounds in (0, 3):
        got = {r.doc_id: r.component_id for r in jaccard_components(docs, rule, rounds=rounds).collect()}
        assert got == want


def test_a_set_travels_about_once(spark, monkeypatch):
    # 30 near copies of one text, and texts just below the threshold that sketches of one bit per member let pass.
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:13 * i] + [f"x{i}"] + base[13 * i + 1:])) for i in range(30)]
    rows += [(100 + i, " ".join(w if k % 26 else f"y{i}.{rng.random()}" for k, w in enumerate(base))) for i in range(10)]
    sizes, lists = {"compared": 0}, defaultdict(set)
    verified, stored = jaccard._Verifier._verified, jaccard.stored

    def counted(self, pairs, members):
        sizes["compared"] += pairs.count()
        return verified(self, pairs, members)

    def kept(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        if name == "shared":
            for row in out.collect():
                lists[row.key].add(row.id)
        return out

    monkeypatch.setattr(jaccard._Verifier, "_verified", counted)
    monkeypatch.setattr(jaccard, "stored", kept)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, JaccardRule(3, 90), rounds=0, boundary=10**6, count_links=False).collect()}
    assert got == {i: 0 if i < 30 else i for i, _ in rows}
    assert sizes["compared"] < 4 * 30  # of 435 pairs of near copies
    assert sizes["near"] <= sizes["close"]
    assert len({frozenset(x) for x in lists.values()}) == len(lists)


def test_finer_sketches_tell_more(spark):
    rng = np.random.default_rng(3)
    common, own = rng.integers(0, 1 << 63, 700, np.uint64), rng.integers(0, 1 << 63, (2, 100), np.uint64)
    a, b = (np.concatenate([common, x]) for x in own)
    bounds = [sketch_distance(odd_sketch(a, n), odd_sketch(b, n)) for n in (1, 4)]
    assert bounds[0] <= bounds[1] <= 200 and bounds[1] > 180


def test_groups_in_blocks_of_long_lists(spark, monkeypatch):
    """Every list counts as long and has several blocks."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 1)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 3)
    rows = [(k, " ".join(f"c{i}" for i in range(k * 3, k * 3 + 60 + 40 * (k % 3)))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    rule = JaccardRule(3, 80)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, rule, rounds=0).collect()}
    assert got == groups_by_hand(rows, rule)


def test_group_query(spark, sf, texts):
    want = groups_by_hand(list(texts.items()), JaccardRule(3, 90))
    got = {r.doc_id: r.component_id for r in queries.op2_heavy_light_join(spark, sf).collect()}
    assert got == want


def links_by_hand(rows, rule):
    """Other ids with an equal or a linking set, per id."""
    sets = [(i, shingles(t, rule.words)) for i, t in rows if i is not None]
    out = {i: set() for i, _ in sets}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i != j and a and b and 100 * len(a & b) >= rule.percent * len(a | b):
                out[i].add(j)
                out[j].add(i)
    return {i: len(x) for i, x in out.items()}


def near_copies():
    """A hub, 60 spokes that all link with it and few with each other, exact copies, and ids with several sets."""
    base = [f"b{i}" for i in range(200)]
    rows = [(5, " ".join(base)), (6, " ".join(base).upper()), (7, " ".join(base))]
    for k in range(60):
        spoke = list(base)
        spoke[3 * k] = f"s{k % 30}"
        spoke[(3 * k + 90) % 200] = f"t{k % 30}"
        rows += [(100 + k, " ".join(spoke))] * (1 + k % 2) + [(200 + k, " ".join(spoke))] * (k % 3 == 0)
    rows += [(300 + k, " ".join(f"c{i}" for i in range(k * 2, k * 2 + 80))) for k in range(20)]
    return rows


@pytest.mark.parametrize("several, block", [(False, 64), (True, 4)])
def test_all_links_are_counted(spark, monkeypatch, several, block):
    monkeypatch.setattr(jaccard, "LINK_BLOCK", block)
    rows = near_copies()
    if several:  # ids with linking sets, with sets of two groups, and with a set of its own
        rows += [(5, rows[3][1]), (100, rows[-1][1]), (300, rows[-2][1]), (319, words(5, 50)), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    rule = JaccardRule(3, 90)
    want = links_by_hand(rows, rule)
    for rounds in (0, 3):
        got = {r.doc_id: r.n_links for r in jaccard_components(docs, rule, rounds=rounds).collect() if r.doc_id is not None}
        assert got == want
    assert max(want.values()) > 60


def test_links_themselves(spark):
    rows = near_copies()
    rule = JaccardRule(3, 90)
    found = jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rule)
    has = {r.id: r.digest for r in found.members.collect()}
    pairs = {(bytes(r.a), bytes(r.b)) for r in found.pairs.collect()}
    sets = {i: shingles(t, 3) for i, t in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            assert (100 * len(a & b) >= 90 * len(a | b)) == (has[i] == has[j] or (bytes(has[i]), bytes(has[j])) in pairs)


def test_link_counts_of_the_query(spark, sf, texts, edges):
    want = links_by_hand(list(texts.items()), JaccardRule(3, 90))
    assert {r.doc_id: r.n_links for r in queries.op2_heavy_light_join(spark, sf).collect()} == want
    want = links_by_hand(edge_rows(), JaccardRule(3, 90))
    assert {r.doc_id: r.n_links for r in jaccard_components(edges, JaccardRule(3, 90)).where("doc_id is not null").collect()} == want


def test_common_members():
    draw = np.random.default_rng(3)
    left, right = ([np.unique(draw.integers(0, 9000, n)) for n in sizes] for sizes in ((0, 3000, 10, 5000), (4000, 1, 0)))
    assert common_members(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_groups_empty(empty):
    assert jaccard_components(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**63), max_size=300), st.sets(st.integers(0, 2**63), max_size=40), st.integers(0, 200))
def test_sketches_never_overstate(a, new, drop):
    b = set(sorted(a)[drop:]) | new
    x, y = (odd_sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
    assert sketch_distance(x, y) <= len(a ^ b)


def listed(sets, rule, boundary):
    """The keys of the lists that each set is in; shingles are ordered by value."""
    sizes = np.array([len(x) for x in sets], np.int64)
    want = np.minimum(rule.prefix(sizes) + rule.classes(rule.band(rule.reach(sizes))), sizes)
    prefix = np.concatenate([np.sort(x)[:n] for x, n in zip(sets, want)])
    owner, key = jaccard.list_keys(prefix, np.concatenate([[0], np.cumsum(want)]), sizes, rule, boundary)
    return [set(key[owner == i].tolist()) for i in range(len(sets))], np.bincount(owner, minlength=len(sets))


@pytest.mark.parametrize("percent", [50, 80, 90])
@pytest.mark.parametrize("boundary", [0, 39, 300])
def test_sets_that_link_share_a_list(percent, boundary):
    rule, draw = JaccardRule(3, percent), np.random.default_rng(percent + boundary)
    linked = 0
    for size in [*range(1, 80), 127, 128, 129, 160, 255, 256, 500, 512, 700]:
        whole = draw.integers(0, 2**63, 3 * size + 2).astype(np.uint64)
        for least in [rule.overlap(size), *draw.integers(rule.overlap(size), size + 1, 4)]:
            for extra in {0, int(draw.integers(0, rule.reach(size) - size + 1)), max(0, int(rule.reach(least) - size))}:
                a, b = whole[:size], whole[size - least:size + extra]
                if (least < size or extra) and rule.links(least, len(a), len(b)):
                    keys, _ = listed([a, b], rule, boundary)
                    linked += 1
                    assert keys[0] & keys[1]
    assert linked > 100


def test_lists_grow_with_the_shingles_of_a_set():
    """Rows of a set are in proportion to its size, also where all pairs of its prefix would be many."""
    rule, draw = JaccardRule(5, 80), np.random.default_rng(5)
    sets = [draw.integers(0, 2**63, n).astype(np.uint64) for n in (30, 90, 500, 1000, 4000, 20_000)]
    _, rows = listed(sets, rule, jaccard.most_paired(rule))
    assert all(n <= 1.5 * len(x) + 20 for n, x in zip(rows, sets))


def test_one_shared_shingle_or_unlike_sizes_make_no_candidates(spark, monkeypatch):
    """Long texts with one common rare passage, and a short text beside a long one, are in no comparison."""
    counts, stored = defaultdict(int), jaccard.stored
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *_: 10**6)

    def kept(df, name):
        out = stored(df, name)
        counts[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", kept)
    rows = [(k, " ".join([*(f"a{k}x{i}" for i in range(300)), "one", "rare", "passage", *(f"b{k}x{i}" for i in range(300))])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, JaccardRule(3, 80), count_links=False).collect()}
    assert got == {k: k for k, _ in rows}
    assert counts["shared"] + counts["share"] == 0 and counts["lists"] < 30 * 1000
    hashes = np.random.default_rng(2).integers(0, 2**63, 7000).astype(np.uint64)
    sketches = [odd_sketch(hashes[:468]), odd_sketch(hashes[460:])]
    assert jaccard.close_pairs(np.array([468, 6540]), sketches, np.array([0, 1]), None, JaccardRule(5, 80)) == []


def test_scratch_tables_of_the_join_are_removed(spark, monkeypatch):
    written, stored = {}, jaccard.stored

    def kept(df, name):
        out = stored(df, name)
        written.setdefault(name, []).append(out.inputFiles()[0].removeprefix("file:").replace("//", "/"))
        return out

    monkeypatch.setattr(jaccard, "stored", kept)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    jaccard_components(docs, JaccardRule(3, 90), count_links=False).collect()
    for name in ("sets", "lists", "members"):
        assert written[name] and not any(os.path.exists(x) for x in written[name])
    assert os.path.exists(written["nodes"][0])


def test_boundary_follows_cost():
    rule = JaccardRule(3, 90)
    sizes = {n: 10 for n in range(9, 400)}
    low, high = choose_boundary(sizes, 0.1, rule), choose_boundary(sizes, 5.0, rule)
    assert 9 <= low < high < 400 and choose_boundary({}, 1.0, rule) == 0
