"""A factorisation machine that scores the quality of whole texts."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.blocks import split, text_blocks
from textloom.llm.hashing import flat_words

# Labelled texts that the model is fitted on, at most; chosen by a hash of the id.
FIT_ROWS = 12_000
SLOTS = 1 << 17
# Bytes of text whose features are made at once; they take some twenty times as much memory.
BLOCK = 2 << 20
STATS = ("words", "word_length", "symbols", "capitals", "digits", "exclaims", "pipes", "punctuation",
         "lines", "repeated_words", "repeated_lines", "n_chars")
BINS = 24
FEATURES = SLOTS + len(STATS) * (BINS + 1)


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum w x + half the sum over factors of (sum v x)^2 - sum (v x)^2)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` texts before the sigmoid; linear in the number of (doc, feature, value) rows."""
        starts = np.searchsorted(doc, np.arange(n + 1))
        linear = _sums(self.weights[feature] * value, starts)
        vx = self.factors[feature] * value[:, None]
        sums, squares = _sums(vx, starts), _sums(vx * vx, starts)
        return self.bias + linear + .5 * (sums ** 2 - squares).sum(axis=1)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over the runs that begin at ``starts``; an empty run sums to 0."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


_CLASSES = {
    "symbols": b"#*$%&<>@^~_=+{}[]\\", "digits": b"0123456789", "exclaims": b"!", "pipes": b"|", "punctuation": b".,;:?",
    "capitals": bytes(range(65, 91)), "blank": b" \t\n\r\x0b\x0c", "lines": b"\n",
}


def features(texts: list[bytes], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (doc, feature, value) sorted by doc: hashed words, and one bin of every statistic.

    Words are lower-cased and weighted by the logarithm of their count, scaled to length 1
    per text; every statistic has an index range of its own and the value 1/2.
    """
    n = len(texts)
    hashes, starts = flat_words([t.lower() for t in texts])
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(starts))
    key, counts = np.unique(doc * SLOTS + (hashes & np.uint64(SLOTS - 1)).astype(np.int64), return_counts=True)
    word_doc, word = key // SLOTS, key % SLOTS
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(word_doc, value * value, minlength=n))
    value = value / np.maximum(norm, 1e-9)[word_doc]

    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    seen = {}
    for name, chars in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        seen[name] = np.diff(np.concatenate([[0], np.cumsum(table[data])])[ends])
    words = np.diff(starts)
    solid = sizes - seen["blank"]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    stats = {
        "words": np.log1p(words) / 12, "word_length": _share(solid, words) / 16,
        "symbols": _share(seen["symbols"], solid) * 3, "capitals": _share(seen["capitals"], solid),
        "digits": _share(seen["digits"], solid) * 2, "exclaims": _share(seen["exclaims"], solid) * 4,
        "pipes": _share(seen["pipes"], solid) * 6, "punctuation": _share(seen["punctuation"], solid) * 4,
        "lines": _share(seen["lines"], words) * 4, "repeated_words": 1 - _share(np.bincount(word_doc, minlength=n), words),
        "repeated_lines": 1 - _share(np.array([len(set(x)) for x in lines]), n_lines),
        "n_chars": np.log1p(np.array([max(0, c) if c is not None else 0 for c in n_chars], float)) / 16,
    }
    bins = np.stack([np.where(np.clip(stats[s], 0, 1) > 0, 1 + np.clip(stats[s], 0, 1 - 1e-9) * BINS, 0).astype(np.int64)
                     for s in STATS], axis=1)
    stat = SLOTS + np.arange(len(STATS)) * (BINS + 1) + bins
    all_doc = np.concatenate([word_doc, np.repeat(np.arange(n), len(STATS))])
    order = np.argsort(all_doc, kind="stable")
    return all_doc[order], np.concatenate([word, stat.ravel()])[order], np.concatenate(
        [value, np.full(n * len(STATS), .5)])[order].astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = 8, epochs: int = 8,
        rate: float = .08, decay: float = 1e-5, batch: int = 128, seed: int = 7) -> Machine:
    """Fit by AdaGrad on the logistic loss; ``rows`` has (features, values) of each text."""
    draw = np.random.default_rng(seed)
    w, v = np.zeros(FEATURES, np.float32), draw.normal(0, .05, (FEATURES, factors)).astype(np.float32)
    gw, gv = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, factors), 1e-2, np.float32)
    bias, gb = 0.0, 1e-2
    if not len(labels):
        return Machine(20.0, w, np.zeros_like(v))  # nothing is known against any text
    for _ in range(epochs):
        order = draw.permutation(len(labels))
        for start in range(0, len(order), batch):
            chosen = order[start:start + batch]
            feature = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            sizes = np.array([len(rows[i][0]) for i in chosen])
            at = np.concatenate([[0], np.cumsum(sizes)])
            doc = np.repeat(np.arange(len(chosen)), sizes)
            score = Machine(bias, w, v).raw(doc, feature, value, len(chosen))
            error = ((1 / (1 + np.exp(-score)) - labels[chosen]) / len(chosen) * 16).astype(np.float32)
            vx = v[feature] * value[:, None]
            dv = (error[doc] * value)[:, None] * (_sums(vx, at)[doc] - vx)
            dw = error[doc] * value
            used, place = np.unique(feature, return_inverse=True)
            sw = np.bincount(place, dw, minlength=len(used)).astype(np.float32) + decay * w[used]
            sv = np.stack([np.bincount(place, dv[:, k], minlength=len(used)) for k in range(factors)], axis=1).astype(
                np.float32) + decay * v[used]
            gw[used] += sw * sw
            gv[used] += sv * sv
            w[used] -= rate * sw / np.sqrt(gw[used])
            v[used] -= rate * sv / np.sqrt(gv[used])
            gb += float(error.sum()) ** 2
            bias -= rate * float(error.sum()) / gb ** .5
    return Machine(bias, w, v)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fit on at most ``fit_rows`` texts of ``docs`` with a label (doc_id, quality).

    The rows are those with the least hash of their id. Their features are made in Spark tasks; the
    driver gets about 2 kB per row. Null ids and labels are left out, repeated
    labels of an id are averaged; without labels every text scores (nearly) 1.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
        .agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    joined = docs.select("doc_id", "text", F.col("n_chars").cast("bigint").alias("n_chars")).join(F.broadcast(chosen), "doc_id")

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, feature, value = features(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
        at = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("quality"), pa.ListArray.from_arrays(at, pa.array(feature.astype(np.int32))),
             pa.ListArray.from_arrays(at, pa.array(value))], ["doc_id", "quality", "features", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = text_blocks(joined, block, f"doc_id {kind}, quality double, features array<int>, values array<float>",
                        extra=("n_chars", "quality"), block_bytes=BLOCK).toArrow()
    table = table.sort_by("doc_id")
    rows = [(np.asarray(f.values), np.asarray(v.values)) for f, v in zip(table["features"], table["values"])]
    return fit(rows, np.asarray(table["quality"].to_numpy()) >= .5)


def score_quality(docs: DataFrame, machine: Machine, threshold: float = .7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text, one row per row of ``docs``.

    The broadcast machine has a fixed size. Nothing is shuffled. Null and empty texts are
    scored by their statistics; a null ``n_chars`` counts as 0; null ids stay null, repeated
    rows are scored alike, an empty table gives no rows, other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = features(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
        score = 1 / (1 + np.exp(-sent.value.raw(*rows, batch.num_rows).astype(np.float64)))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
            ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_blocks(docs, block, f"doc_id {kind}, score double, predicted int",
                       extra=(F.col("n_chars").cast("bigint").alias("n_chars"),), block_bytes=BLOCK)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's labels are kept for tests: a quarter of the ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_quality(docs: DataFrame, machine: Machine, threshold: float = .7) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns.

    Scored and filtered in one pass over each partition, without a join; rows as in
    ``score_quality``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def batches(given):
        for batch in given:
            if batch.num_rows == 0:
                continue
            # Text as UTF-8 bytes, null as empty, next to the row's own columns.
            text = pc.fill_null(batch.column(text_at).cast(pa.binary()), b"")
            with_text = pa.RecordBatch.from_arrays(
                [text, pa.array(np.arange(batch.num_rows)), batch.column(chars_at)], ["text", "row", "n_chars"])
            for block in split(with_text, BLOCK):
                rows = features(block.column("text").to_pylist(), block.column("n_chars").to_pylist())
                score = 1 / (1 + np.exp(-sent.value.raw(*rows, block.num_rows).astype(np.float64)))
                yield batch.take(block.column("row").filter(pa.array(score >= threshold)))

    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars")
    return docs.mapInArrow(batches, docs.schema)
