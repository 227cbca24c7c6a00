"""Size-aware join of word-shingle sets by Jaccard similarity, and its connected groups.

Sets are ordered by one global order of shingles, rare ones first. Two sets that reach the
threshold share at least k shingles within the first ``size - least overlap + k`` of both.

* Small sets enumerate the pairs (fixed-size subsets) of that prefix for k = 2: few, and very selective.
* Large sets would have too many. Their prefix shingles are dealt into g classes by hash, and k = g + 1 shared ones
  put two into one class: only pairs inside classes go into inverted lists, about three rows per shingle that
  decides, whatever the size. Sets of one band of sizes (a power of two) have the same g, and a set enters the bands
  of all larger sets that it can link with. Small sets that a large one can reach enter the lists too.
* The boundary between the two is where the estimated cost of both ways is least, and at most where all
  pairs are still few.

Equal sets are one node. Lists hold links of whole groups, so a list is not paired up at
once: its rows are first compared with one central row of the list, in rounds, and only rows of
groups that are still apart are compared with each other. No link is lost that way, and a
group of near copies costs a few comparisons per copy instead of the square. Lists with the same rows are one list.
Candidates are sorted out by sketches; whole sets travel for the pairs left, first one pair per set, then
the pairs whose ends are still apart. Rows of long lists that are
still apart are compared by sketches inside tasks, block against block, and only close pairs become rows.

The groups are known then, and every link lies inside one. Their sets are compared once more, each
with each, block against block inside tasks, and tasks return the number of links of each set: a group of
n near copies has up to n * n / 2 links, but no pair becomes a row.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.blocks import split, stored, text_blocks
from textloom.llm.hashing import flat_words, inside, mixed, window_hashes
from textloom.llm.heavy import with_group
from textloom.operators.graph import connected_components
from textloom.operators.skew import join_ids
from textloom.operators.storage import discard

# The most frequent shingles, ordered last in every set; 8 bytes each in a broadcast.
FREQUENT = 500_000
# A shingle counts as frequent if some block of texts (8 MB) holds it so often.
LOCAL_COUNT = 3
# Rounds of comparisons with central rows, at most; then the rows still apart are compared.
ROUNDS = 6
# Rounds end once so few pairs are left per row, or when one leaves more than this share.
PAIRS_PER_ROW, PAIRS_LEFT = 2, .8
# Lists with more rows are compared inside tasks, in blocks of so many rows, without a row per pair.
LONG_LIST, LIST_BLOCK = 24, 512
# What comparing a candidate costs, in rows of a list.
PAIR_COST = 8
# Small sets have at most so many shingles that decide; classes of a large set for each of them.
MOST_PAIRED, CLASSES = 8, .75
# Rows of lists that one pass over the sets makes and shuffles, for each shingle of the sets, and rows that are worth a pass.
PASS_ROWS, LEAST_PASS = .3, 1 << 22
# Shingles of prefixes whose pairs a worker holds at once (one set may hold more).
LIST_SLICE = 1 << 17
# Bits per member of the finer sketches of sets in candidate pairs; a whole set takes 64.
FINE = 4
# Rows compared with one set in one task.
TOGETHER = 256
# Links are counted in blocks of so many sets, more in groups that would have over LINK_BLOCKS of them, and
# of about so many shingles at most; columns of one product of matrices.
LINK_BLOCK, MOST_LINK_BLOCK, LINK_BLOCKS, LINK_SHINGLES, LINK_COLUMNS = 64, 1024, 16, 1 << 20, 2048


@dataclass(frozen=True)
class JaccardRule:
    """Sets of distinct ``words``-word shingles link at ``percent`` of a hundred or more."""

    words: int = 5
    percent: int = 80

    def overlap(self, size):
        """Least overlap of a set of this size with any set it links with."""
        return (self.percent * size + 99) // 100

    def prefix(self, size):
        """How many shingles of a set decide: any link shares one among them."""
        return size - self.overlap(size) + 1

    def band(self, size):
        """The power of two at or below a size; sizes of one band have the same classes."""
        return np.frexp(np.maximum(size, 1))[1] - 1

    def classes(self, band):
        """Classes of the sets of a band: fewer than any two of them share where they link, one at least."""
        least = np.left_shift(np.int64(1), np.asarray(band, np.int64))
        return np.maximum(np.minimum((CLASSES * self.prefix(least)).astype(np.int64), self.overlap(least) - 1), 1)

    def reach(self, size):
        """The largest set that one of this size can link with."""
        return 100 * size // self.percent

    def links(self, common, size_a, size_b):
        return (100 * common >= self.percent * (size_a + size_b - common)) & (common > 0)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted. A-Z are lower-cased; a text with fewer words
    than a shingle has its whole sequence as the only one, and none without words."""
    flat, starts = flat_words([t.lower() for t in texts])
    windows, parts = window_hashes(flat, words), []
    # Text by text: short runs sort far faster than one long array.
    for first, last in zip(starts[:-1].tolist(), starts[1:].tolist()):
        size = last - first
        if size >= words:
            own = np.sort(windows[first:last - words + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        else:
            own = mixed(window_hashes(flat[first:last], size) + np.uint64(size)) if size else flat[:0]
        parts.append(own)
    return np.repeat(np.arange(len(texts)), [len(p) for p in parts]), np.concatenate(parts) if parts else flat[:0]


def digests(hashes: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """16 bytes of every set, equal for equal sets."""
    two = [mixed(hashes + np.uint64(1)), mixed(hashes ^ np.uint64(0xA0761D6478BD642F))]
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in two]
    return [x.tobytes() for x in np.stack([s[starts[1:]] - s[starts[:-1]] for s in sums], axis=1)]


def odd_sketch(hashes: np.ndarray, times: int = 1) -> bytes:
    """Bits that each member flips; ``times`` as many as the set has members, up to a power of two.

    Members that two sets share cancel out, so the bits that differ between two sketches
    are never more than the members in which the sets differ.
    """
    size = 1 << max(6, int(times * len(hashes) - 1).bit_length())
    at = (mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the members in which two sets differ; the larger sketch is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.unpackbits(x ^ y).sum())


def frequent_shingles(docs: DataFrame, rule: JaccardRule, most: int) -> np.ndarray:
    """Hashes of the ``most`` most frequent shingles, least frequent first.

    Every block counts all its texts, repeats inside a text included; what it holds once or twice is
    left out, which only concerns rare shingles. The order matters for speed, not for results.
    """
    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, starts = flat_words([t.lower() for t in batch.column("text").to_pylist()])
        value, n = np.unique(window_hashes(flat, rule.words)[inside(starts, rule.words)], return_counts=True)
        often = n >= LOCAL_COUNT
        return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(n[often])], ["value", "n"])

    sums = text_blocks(docs.select("id", "text"), counts, "value bigint, n bigint", "id").groupBy("value").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "value").limit(most).toArrow()
    return top.column("value").to_numpy()[::-1].view(np.uint64) if len(top) else np.empty(0, np.uint64)


def _describe(docs: DataFrame, rule: JaccardRule, frequent: np.ndarray, kind: str) -> DataFrame:
    """(id, size, digest, prefix, sketch) of every row; the prefix holds one shingle more than decides for each class."""
    sent = docs.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent)))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        doc, hashes = shingle_sets(batch.column("text").to_pylist(), rule.words)
        sizes = np.bincount(doc, minlength=n)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        known, rank = sent.value
        key = hashes >> np.uint64(1)
        if len(known) and len(hashes):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            key[hit] = np.uint64(1 << 63) + rank[at[hit]].astype(np.uint64)
        want = np.minimum(rule.prefix(sizes) + rule.classes(rule.band(rule.reach(sizes))), sizes)
        offsets = np.concatenate([[0], np.cumsum(want)])
        prefix = [hashes[:0]]
        for first, last, n_first in zip(starts[:-1].tolist(), starts[1:].tolist(), want.tolist()):
            if n_first:
                own = key[first:last]
                least = np.argpartition(own, n_first - 1)[:n_first]
                prefix.append(hashes[first + least[np.argsort(own[least])]])
        return pa.RecordBatch.from_arrays([
            batch.column("id"), pa.array(sizes.astype(np.int32)), pa.array(digests(hashes, starts), pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(prefix).view(np.int64))),
            pa.array([odd_sketch(hashes[a:b]) if b > a else b"" for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
        ], ["id", "size", "digest", "prefix", "sketch"])

    return text_blocks(docs, block, f"id {kind}, size int, digest binary, prefix array<bigint>, sketch binary", "id", "text")


def choose_boundary(sizes: dict[int, int], list_length: float, rule: JaccardRule, pair_cost: float = PAIR_COST) -> int:
    """The largest size whose sets should enumerate pairs of prefix shingles: least total cost.

    A pair costs one row. A shingle in an inverted list costs a row and the scan of the
    ``list_length`` other rows it meets there.
    """
    best, boundary = 0.0, 0
    saved = 0.0
    for size in sorted(sizes):
        single = rule.prefix(size)
        pairs = (single + 1) * single // 2
        saved += sizes[size] * (single * (1 + pair_cost * list_length) - pairs)
        if saved > best:
            best, boundary = saved, size
    return boundary


def most_paired(rule: JaccardRule) -> int:
    """The largest size of which at most ``MOST_PAIRED`` shingles decide."""
    sizes = np.arange(1, 1 + 100 * (MOST_PAIRED + 1) // max(1, 100 - rule.percent) + 100)
    return int(sizes[rule.prefix(sizes) <= MOST_PAIRED].max(initial=0))


def list_keys(prefix: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rule: JaccardRule, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of all lists that the sets are in; ``prefix`` from ``starts`` on are the first shingles of each."""
    low, high = rule.band(sizes), rule.band(rule.reach(sizes))
    listed = rule.reach(sizes) > boundary
    ways = [(np.flatnonzero(sizes <= boundary), np.ones(len(sizes), np.int64), np.full(len(sizes), -1))]
    for step in range(int((high - low).max(initial=0)) + 1):
        band = low + step
        ways.append((np.flatnonzero(listed & (band <= high)), rule.classes(band), band))
    owners, keys = [], []
    lengths = np.diff(starts)
    for rows, classes, band in ways:
        # One shingle more than decides for each class: two of them share a class.
        count = np.minimum(rule.prefix(sizes[rows]) + classes[rows], lengths[rows])
        owner = np.repeat(rows, count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
        value = mixed(prefix[at] ^ np.uint64(0x8EBC6AF09C88C6E3))
        place = owner << 32 | ((value >> np.uint64(20)) % classes[owner].astype(np.uint64)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        owner, value, place = owner[order], value[order], place[order]
        for lag in range(1, len(place)):
            first = np.flatnonzero(place[lag:] == place[:-lag])
            if not len(first):
                break
            owners.append(owner[first])
            keys.append(mixed(value[first] + value[first + lag] + band[owner[first]].astype(np.uint64)))
    # Sets that link by a single shingle.
    rows = np.flatnonzero((rule.overlap(sizes) < 2) & (sizes > 0))
    count = np.minimum(rule.prefix(sizes[rows]), lengths[rows])
    owner = np.repeat(rows, count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
    return np.concatenate([*owners, owner]), np.concatenate([*keys, prefix[at]]).view(np.int64)


def _lists(nodes: DataFrame, rule: JaccardRule, boundary: int, part: int, parts: int, kind: str) -> DataFrame:
    """(key, id, size): the rows of one of ``parts`` equal shares of the lists that a set is in."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("prefix")
            ends = held.offsets.to_numpy().astype(np.int64)
            first = 0
            while first < batch.num_rows:
                last = min(batch.num_rows, max(first + 1, int(np.searchsorted(ends, ends[first] + LIST_SLICE, "right")) - 1))
                prefix = held.values.slice(ends[first], ends[last] - ends[first]).to_numpy().view(np.uint64)
                owner, key = list_keys(prefix, ends[first:last + 1] - ends[first], batch.column("size").to_numpy()[first:last].astype(np.int64), rule, boundary)
                own = np.flatnonzero(key.view(np.uint64) % np.uint64(parts) == part)
                at = pa.array(owner[own] + first)
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), batch.column("id").take(at), batch.column("size").take(at)], ["key", "id", "size"])
                first = last

    # A set so small that every set it could link with is equal to it is in no list.
    some = nodes.where(F.floor(100 * F.col("size") / rule.percent) > F.col("size"))
    return some.select("id", "size", "prefix").mapInArrow(rows, f"key bigint, id {kind}, size int")


def _shared_lists(nodes: DataFrame, rule: JaccardRule, boundary: int, kind: str) -> DataFrame:
    """(key, id, size) of the lists with several rows; near copies share most of their lists, and those with the same rows are one.

    The lists are made in shares of about ``PASS_ROWS`` rows per shingle, one after the other: what a share
    writes and shuffles is removed before the next one.
    """
    shingles, rows = nodes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(2 * F.size("prefix")), F.lit(0))).first()
    parts = max(1, min(-(-rows // LEAST_PASS), int(np.ceil(rows / max(1, PASS_ROWS * shingles)))))
    shares = []
    for part in range(parts):
        lists = stored(_lists(nodes, rule, boundary, part, parts, kind), "lists")
        listed = with_group(lists, "key", {"rows": F.bit_xor(F.xxhash64("id"))}, smallest=2)
        shares.append(stored(listed.select(F.xxhash64("rows", "n").alias("key"), "id", "size").distinct(), "share"))
        discard(lists)
    return stored(reduce(DataFrame.union, shares).distinct(), "shared") if parts > 1 else shares[0]


def _may_link(size_a: Column, size_b: Column, rule: JaccardRule) -> Column:
    return 100 * F.least(size_a, size_b) >= rule.percent * F.greatest(size_a, size_b)


def _fold(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def close_pairs(sizes: np.ndarray, sketches: list[bytes], groups: np.ndarray, sides: np.ndarray | None,
                rule: JaccardRule) -> list[tuple[int, int]]:
    """Rows (i, j) of different groups, and different sides if given, whose sketches allow a link.

    Sketches of one length are compared as a matrix; longer ones are folded to that length.
    """
    out = []
    lengths = np.array([len(s) for s in sketches])
    by_length = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    for n, rows in by_length.items():
        matrix = np.stack([np.frombuffer(sketches[i], np.uint64) for i in rows])
        others = [(rows, matrix)]
        for longer in (cols for m, cols in by_length.items() if m > n):
            folded = np.stack([np.frombuffer(sketches[i], np.uint64) for i in longer])
            while folded.shape[1] > matrix.shape[1]:
                folded = _fold(folded)
            others.append((longer, folded))
        for cols, against in others:
            for k, i in enumerate(rows):
                least = np.bitwise_count(against ^ matrix[k]).sum(axis=1).astype(np.int64)
                most = np.minimum((sizes[i] + sizes[cols] - least) // 2, np.minimum(sizes[i], sizes[cols]))
                fits = rule.links(most, sizes[i], sizes[cols]) & (groups[cols] != groups[i])
                if cols is rows:
                    fits[:k + 1] = False
                if sides is not None:
                    fits &= sides[cols] != sides[i]
                out += [(int(i), int(j)) for j in cols[fits]]
    return out


def _long_lists(rows: DataFrame, nodes: DataFrame, rule: JaccardRule, kind: str) -> DataFrame:
    """(id_a, id_b) of close rows in long lists; every pair of blocks of a list is one group."""
    blocks = F.ceil(F.col("rows") / LIST_BLOCK).cast("int")
    placed = rows.join(nodes.select("id", "sketch"), "id").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "id", "size", "grp", "own", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        ids, own = table.column("id"), table.column("own").to_numpy()
        groups = table.column("grp").to_pylist()
        codes = {g: k for k, g in enumerate(set(groups))}
        found = close_pairs(
            table.column("size").to_numpy().astype(np.int64), table.column("sketch").to_pylist(),
            np.array([codes[g] for g in groups]), own if table.column("low")[0] != table.column("high")[0] else None, rule)
        a, b = (pa.array([p[k] for p in found], pa.int64()) for k in (0, 1))
        return pa.table({"id_a": ids.take(a).combine_chunks(), "id_b": ids.take(b).combine_chunks()})

    return spread.groupBy("key", "low", "high").applyInArrow(compare, f"id_a {kind}, id_b {kind}")


class _Verifier:
    """Groups tied by pairs of nodes that link: first by sketches, then by their whole sets."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, rule: JaccardRule, kind: str):
        self.docs, self.nodes, self.rule, self.kind = docs, nodes, rule, kind

    def merged(self, groups: DataFrame, pairs: DataFrame) -> DataFrame:
        """``groups`` after linking all pairs (a, b) whose sets reach the threshold; ``a`` may be in very many pairs.

        Each ``b`` is compared with one ``a`` first. Pairs whose ends are in one group then say nothing
        new; only the others are compared, so that a set seldom travels more than once.
        """
        close, members = self._close(pairs)
        groups = self._linked(groups, close, members)
        discard(members)
        return groups

    def _linked(self, groups: DataFrame, close: DataFrame, members: DataFrame) -> DataFrame:
        first = stored(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
        groups = _merged(groups, stored(self._verified(first, members), "links"))
        if first.count() == close.count():
            return groups
        a, b = (groups.toDF(c, f"g{c}") for c in "ab")
        placed = close.join(first, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left")
        rest = stored(placed.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b"), "rest")
        return groups if rest.isEmpty() else _merged(groups, stored(self._verified(rest, members), "links"))

    def _close(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The distinct pairs whose sketches allow a link, and (id, members) of their nodes.

        The sketches of all nodes leave many pairs just below the threshold. Finer ones, made only of
        nodes in pairs, sort most of them out before whole sets travel.
        """
        rule, kind = self.rule, self.kind
        close = stored(self._near(pairs, self.nodes.select("id", "size", "sketch")), "close")
        ids = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
        texts = join_ids(self.docs, ids, "id", "left_semi")

        def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, hashes = shingle_sets(batch.column("text").to_pylist(), rule.words)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            fine = [odd_sketch(hashes[a:b], FINE) if b > a else b"" for a, b in zip(at[:-1], at[1:])]
            return pa.RecordBatch.from_arrays([
                batch.column("id"), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64))),
                pa.array(fine, pa.binary())], ["id", "members", "fine"])

        members = stored(text_blocks(texts, sets, f"id {kind}, members array<bigint>, fine binary", "id").where(
            F.size("members") > 0), "members")
        return stored(self._near(close, members.select("id", F.size("members"), "fine")), "near"), members.drop("fine")

    def _near(self, pairs: DataFrame, side: DataFrame) -> DataFrame:
        """The distinct pairs whose sketches in ``side`` (id, size, sketch) allow a link."""
        rule, kind = self.rule, self.kind

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = [batch.column(c).to_numpy() for c in ("size_a", "size_b")]
                least = np.array([sketch_distance(x, y) for x, y in zip(
                    batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())], np.int64)
                # |A xor B| = |A| + |B| - 2 |A and B|, and the smaller set has no more to share than it holds
                most = np.minimum((sizes[0].astype(np.int64) + sizes[1] - least) // 2, np.minimum(*sizes))
                yield batch.filter(pa.array(rule.links(most, *sizes))).select(["a", "b"])

        both = pairs.join(side.toDF("b", "size_b", "sketch_b"), "b").join(side.toDF("a", "size_a", "sketch_a"), "a")
        return both.mapInArrow(near, f"a {kind}, b {kind}").distinct()

    def _verified(self, close: DataFrame, members: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets reach the threshold."""
        rule, kind = self.rule, self.kind
        # One set of ``a`` meets at most about TOGETHER sets in a task, however many pairs it is in.
        parts = close.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
        salted = close.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
        right = salted.join(members.toDF("b", "members"), "b").select("a", "part", "b", "members")
        left = parts.join(members.toDF("a", "members"), "a").select(
            F.col("a").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own_part"), "members")

        def compare(one: pa.Table, many: pa.Table) -> pa.Table:
            out_a, out_b = [], []
            for row in range(one.num_rows):  # several only where an id has several texts
                mine = one.column("members")[row].values.to_numpy()
                for b, other in zip(many.column("b"), many.column("members")):
                    theirs = other.values.to_numpy()
                    common = np.isin(theirs, mine, assume_unique=True).sum() if len(theirs) else 0
                    if rule.links(common, len(mine), len(theirs)):
                        out_a.append(one.column("own")[row].as_py())
                        out_b.append(b.as_py())
            return pa.table({"a": pa.array(out_a, many.schema.field("b").type), "b": pa.array(out_b, many.schema.field("b").type)})

        return left.groupBy("own", "own_part").cogroup(right.groupBy("a", "part")).applyInArrow(compare, f"a {kind}, b {kind}")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(id, grp) after linking; groups without a row are those of a node alone."""
    a = links.join(groups.toDF("a", "ga"), "a", "left").join(groups.toDF("b", "gb"), "b", "left")
    edges = a.select(F.coalesce("ga", "a").alias("src"), F.coalesce("gb", "b").alias("dst"))
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).union(groups.select("id")).distinct()
    components = connected_components(edges).toDF("old", "new")
    joined = ends.join(groups, "id", "left").select("id", F.coalesce("grp", "id").alias("old"))
    return stored(joined.join(components, "old", "left").select("id", F.coalesce("new", "old").alias("grp")), "groups")


def common_members(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set on the left shares with each on the right, by products of 0/1 matrices."""
    sides = [np.repeat(np.arange(len(sets)), [len(x) for x in sets]) for sets in (left, right)]
    values, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    columns = [column[:len(sides[0])], column[len(sides[0]):]]
    both = np.logical_and(*[np.bincount(c, minlength=len(values)) > 0 for c in columns])
    at = np.cumsum(both) - 1
    total = np.zeros((len(left), len(right)), np.float32)  # exact up to 2 ** 24
    entries = []
    for rows, cols in zip(sides, columns):
        kept = both[cols]
        rows, cols = rows[kept], at[cols[kept]]
        order = np.argsort(cols, kind="stable")
        entries.append((rows[order], cols[order]))
    for first in range(0, int(both.sum()), LINK_COLUMNS):
        parts = []
        for (rows, cols), sets in zip(entries, (left, right)):
            a, b = np.searchsorted(cols, [first, first + LINK_COLUMNS])
            part = np.zeros((len(sets), LINK_COLUMNS), np.float32)
            part[rows[a:b], cols[a:b] - first] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def _linked_sets(table: pa.Table, rule: JaccardRule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, other rows, matrix of links) of every group and pair of blocks in the table.

    A set that came with several texts counts once. Inside one block a pair of rows stands in
    the matrix in both orders, across blocks in one.
    """
    keys = list(zip(*[table.column(c).to_pylist() for c in ("grp", "low", "high")]))
    own, digest = table.column("own").to_pylist(), table.column("digest").to_pylist()
    column = table.column("members").combine_chunks()
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    groups: dict[tuple, dict[bytes, int]] = {}
    for row, key in enumerate(keys):
        groups.setdefault(key, {})[digest[row]] = row
    for (_, low, high), found in groups.items():
        rows = [np.array([r for r in found.values() if own[r] == block], np.int64) for block in (low, high)]
        if not len(rows[0]) or not len(rows[1]):
            continue
        sets = [[flat[offsets[r]:offsets[r + 1]] for r in side] for side in rows]
        sizes = [np.array([len(x) for x in side], np.int64) for side in sets]
        linked = rule.links(common_members(*sets), sizes[0][:, None], sizes[1][None, :])
        if low == high:
            np.fill_diagonal(linked, False)
        yield rows[0], rows[1], linked


@dataclass(frozen=True)
class JaccardJoin:
    """``documents`` as ``jaccard_components`` returns them; ``members`` (id, digest) says which sets
    an id has, and ``pairs`` (a, b) has every link between different sets, by digest and in both orders.

    Documents link where they have the same set or sets that are a pair. ``pairs`` is computed when read,
    and has as many rows as links: for a group of near copies, the square of its size.
    """

    documents: DataFrame
    members: DataFrame
    pairs: DataFrame


class _Links:
    """All links inside groups: counted, or as pairs."""

    def __init__(self, docs: DataFrame, classes: DataFrame, groups: DataFrame, rule: JaccardRule, kind: str):
        self.rule = rule
        found = stored(classes.select("id", "digest", "node", "size").distinct(), "members")
        several = stored(found.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("several")), "several")
        self.repeated = not several.isEmpty()
        self.members = stored(found.join(several, "id", "left"), "marked") if self.repeated else found.withColumn(
            "several", F.lit(None).cast("boolean"))
        self.members = self.members.withColumn("several", F.coalesce("several", F.lit(False)))
        nodes = self.members.groupBy("digest", "node", "size").agg(
            F.count_if(~F.col("several")).alias("weight"), F.bool_or("several").alias("several"))
        nodes = nodes.join(groups.toDF("node", "grp"), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
        # Hashes that meet only make blocks smaller: a task tells groups apart.
        placed = with_group(stored(nodes.withColumn("key", F.xxhash64("grp")), "link_nodes"), "key", {"volume": F.sum("size")}, smallest=2)
        block = F.least(F.greatest(F.col("n") / LINK_BLOCKS, F.lit(LINK_BLOCK)), F.lit(MOST_LINK_BLOCK))
        placed = stored(placed.select("digest", F.col("node").alias("id"), "grp", "weight", "several", "size", F.greatest(
            F.ceil(F.col("n") / block), F.ceil(F.col("volume") / LINK_SHINGLES)).cast("int").alias("blocks")), "link_blocks")

        def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, hashes = shingle_sets(batch.column("text").to_pylist(), rule.words)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digests(hashes, at), pa.binary()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64)))], ["id", "digest", "members"])

        # Small groups share tasks.
        rows, volume = placed.where("blocks = 1").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        buckets = F.lit(1 + max(rows // LINK_BLOCK, volume // LINK_SHINGLES))
        texts = join_ids(docs, placed.select("id").distinct(), "id", "left_semi")
        whole = text_blocks(texts, sets, f"id {kind}, digest binary, members array<bigint>", "id").join(placed, ["id", "digest"])
        own = whole.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
        spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "grp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            "own", "blocks", "digest", "weight", "several", "members")
        self.rows = spread.withColumn("bucket", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), buckets)).otherwise(
            F.xxhash64("grp", "low", "high")))

    def degrees(self) -> DataFrame:
        """(digest, links): ids with one set only, by the sets that link with a set, partly summed."""
        rule = self.rule

        def count(table: pa.Table) -> pa.Table:
            weight = table.column("weight").to_numpy()
            total = np.zeros(table.num_rows, np.int64)
            for a, b, linked in _linked_sets(table, rule):
                total[a] += linked @ weight[b]
                if a[0] != b[0]:
                    total[b] += linked.T @ weight[a]
            some = np.flatnonzero(total)
            return pa.table({"digest": table.column("digest").take(some).combine_chunks(), "links": pa.array(total[some])})

        return self.rows.groupBy("bucket").applyInArrow(count, "digest binary, links bigint")

    def pairs(self, only_several: bool = False) -> DataFrame:
        """(a, b): digests of sets that link, in both orders; or only those where an id of one has several sets."""
        rule = self.rule

        def find(table: pa.Table) -> pa.Table:
            several = np.array(table.column("several").to_pylist(), bool)
            out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
            for a, b, linked in _linked_sets(table, rule):
                if only_several:
                    linked = linked & (several[a][:, None] | several[b][None, :])
                i, j = np.nonzero(linked)
                out[0].append(a[i])
                out[1].append(b[j])
                if a[0] != b[0]:
                    out[0].append(b[j])
                    out[1].append(a[i])
            digest = table.column("digest")
            return pa.table({c: digest.take(np.concatenate(x)).combine_chunks() for c, x in zip("ab", out)})

        return self.rows.groupBy("bucket").applyInArrow(find, "a binary, b binary")

    def per_id(self) -> DataFrame:
        """(id, n_links): other ids with a set that equals or links with one of the id's sets."""
        one = F.lit(None).cast(self.members.schema["id"].dataType)
        rows = self.members.select("id", "digest", "several", F.lit(0).cast("bigint").alias("links")).unionByName(
            self.degrees().select(one.alias("id"), "digest", F.lit(True).alias("several"), "links"))
        # Equal sets in any number: their totals are found without moving them to one task.
        summed = with_group(stored(rows, "degrees"), "digest", {
            "links_in_all": F.sum("links"), "weight": F.count_if(~F.col("several"))})
        alone = summed.where("id is not null and not several").select(
            "id", "digest", (F.col("links_in_all") + F.col("weight") - 1).alias("n_links"))
        if not self.repeated:
            return alone.select("id", "n_links")
        # Ids with several sets count once, whichever of their sets link.
        many = self.members.where("several").select("id", "digest")
        sets = many.select("digest").distinct()
        reach = stored(self.pairs(only_several=True).unionByName(sets.select(F.col("digest").alias("a"), F.col("digest").alias("b"))).distinct(), "reach")
        met = reach.join(many.toDF("other", "b"), "b")
        more = met.groupBy(F.col("a").alias("digest")).agg(F.count_distinct("other").alias("more"))
        first = alone.join(more, "digest", "left").select("id", (F.col("n_links") + F.coalesce("more", F.lit(0))).alias("n_links"))
        reached = many.join(reach.withColumnRenamed("a", "digest"), "digest").select("id", "b").distinct()
        weights = self.members.where(~F.col("several")).groupBy(F.col("digest").alias("b")).agg(F.count("*").alias("weight"))
        plain = reached.join(weights, "b").groupBy("id").agg(F.sum("weight").alias("plain"))
        again = reached.join(many.toDF("other", "b"), "b").groupBy("id").agg(F.count_distinct("other").alias("again"))
        return first.unionByName(again.join(plain, "id", "left").select(
            "id", (F.coalesce("plain", F.lit(0)) + F.col("again") - 1).alias("n_links")))


def jaccard_components(
    docs: DataFrame, rule: JaccardRule | None = None, id_col: str = "doc_id", text_col: str = "text",
    frequent: int = FREQUENT, rounds: int = ROUNDS, boundary: int | None = None, count_links: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links.

    ``component_id`` is the least id that links lead to, the document itself included;
    ``n_shingles`` the size of the set; ``n_links`` the number of other ids that the document links with,
    those with an equal set included; without ``count_links`` there is no such column.
    ``boundary`` overrides the size chosen by cost.

    Texts without words have no set and link with nothing, also not with each other. Null
    texts are empty. Rows that repeat an id are one document, connected to whatever any of
    them links with. A null id has no component. An empty table gives no rows; other columns
    are not read.
    """
    documents, _ = _joined(docs, rule, id_col, text_col, frequent, rounds, boundary, count_links)
    return documents


def jaccard_join(
    docs: DataFrame, rule: JaccardRule | None = None, id_col: str = "doc_id", text_col: str = "text",
    frequent: int = FREQUENT, rounds: int = ROUNDS, boundary: int | None = None,
) -> JaccardJoin:
    """``jaccard_components`` with the links themselves, all of them."""
    documents, links = _joined(docs, rule, id_col, text_col, frequent, rounds, boundary, True)
    return JaccardJoin(documents, links.members.select("id", "digest"), links.pairs())


def _joined(
    docs: DataFrame, rule: JaccardRule | None, id_col: str, text_col: str, frequent: int, rounds: int,
    boundary: int | None, count_links: bool,
) -> tuple[DataFrame, _Links | None]:
    rule = rule or JaccardRule()
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = stored(_describe(given, rule, frequent_shingles(given, rule, frequent), kind), "sets")

    # Equal sets: the least id stands for all.
    full = sets.where("id is not null and size > 0")
    classes = stored(with_group(full.select("id", "digest", "size"), "digest", {"node": F.min("id")}).select("id", "digest", "size", "node"), "classes")
    per_id = classes.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    # An id with several sets ties their nodes together.
    ties = per_id.where("low <> high").join(classes, "id").where("node <> low").select(
        F.col("low").alias("a"), F.col("node").alias("b"))
    first = full.join(classes.where("id = node").select("id").distinct(), "id", "left_semi")
    nodes = stored(first.dropDuplicates(["id", "digest"]), "nodes")
    narrow = stored(sets.select("id", "size"), "sizes")
    discard(sets)

    if boundary is None:
        sample = nodes.select(F.explode("prefix").alias("x")).where(F.pmod("x", F.lit(64)) == 0).groupBy("x").count()
        met = sample.agg(F.sum(F.col("count") * (F.col("count") - 1)) / F.sum("count")).first()[0] or 0.0
        boundary = min(choose_boundary(_histogram(nodes), met, rule), most_paired(rule))

    shared = _shared_lists(nodes, rule, boundary, kind)
    verify = _Verifier(given, nodes, rule, kind)
    groups = nodes.where(F.lit(False)).select("id", F.col("id").alias("grp"))
    if not ties.isEmpty():
        groups = _merged(groups, ties)
    before = None
    for number in range(rounds + 1):
        placed = stored(shared.join(groups, "id", "left").withColumn("grp", F.coalesce("grp", "id")), "placed")
        per_group = placed.groupBy("key", "grp").agg(F.count("*").alias("m"))
        apart = stored(per_group.groupBy("key").agg(
            F.sum("m").alias("rows"), ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs"),
        ).where("pairs > 0"), "apart")
        rows, pairs = apart.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        if not pairs:
            break
        open_rows = placed.join(apart.select("key", "rows"), "key")
        last = number == rounds or pairs <= PAIRS_PER_ROW * rows or (before is not None and pairs > PAIRS_LEFT * before)
        before = pairs
        if last:
            short = open_rows.where(F.col("rows") <= LONG_LIST)
            a, b = (short.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "size", "grp")]) for s in "ab")
            candidates = a.join(b, "key").where(
                (F.col("grp_a") < F.col("grp_b")) & _may_link(F.col("size_a"), F.col("size_b"), rule)
            ).select("id_a", "id_b").unionByName(_long_lists(open_rows.where(F.col("rows") > LONG_LIST), nodes, rule, kind))
        else:
            # The row that shares most is likely the text the others were copied from.
            score = open_rows.groupBy("id").agg(F.sum(F.log2("rows")).alias("score"))
            scored = open_rows.join(score, "id")
            turn = F.col("score") if number % 2 == 0 else F.pmod(F.xxhash64("id", F.lit(number)), F.lit(1 << 20)).cast("double")
            centre = scored.groupBy("key").agg(F.max(F.struct(turn.alias("t"), "id", "size", "grp")).alias("c"))
            candidates = scored.join(centre, "key").where(
                (F.col("c.grp") != F.col("grp")) & _may_link(F.col("c.size"), F.col("size"), rule)
            ).select(F.col("c.id").alias("id_a"), F.col("id").alias("id_b"))
        groups = verify.merged(groups, candidates.toDF("a", "b").distinct())
        if last:
            break
    node_of = per_id.select("id", F.col("low").alias("node"))
    result = node_of.join(groups.toDF("node", "grp"), "node", "left").select("id", F.coalesce("grp", "node").alias("component_id"))
    whole = narrow.join(result, "id", "left")
    columns = [F.col("id").alias("doc_id"), F.col("size").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")]
    if not count_links:
        return whole.select(*columns), None
    links = _Links(given, classes, groups, rule, kind)
    counted = whole.join(links.per_id(), "id", "left")
    return counted.select(*columns, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), links


def _histogram(nodes: DataFrame) -> dict[int, int]:
    """Sets per size up to 1000, where enumerating pairs has long become dearer."""
    return dict(nodes.where("size <= 1000").groupBy("size").count().collect())
