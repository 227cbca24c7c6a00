"""Epoch shuffles and batches per training process."""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.positions import with_position

ROUNDS = 4
# A step leaves the domain again in less than half of all cases; so many in a row practically never do.
WALK = 200


def _round_keys(seed: int, epoch: int, bits: int) -> list[tuple[int, int]]:
    """An odd factor below 2^20 and a summand below 2^bits for each round, from a digest."""
    keys = []
    for i in range(ROUNDS):
        digest = hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest()
        keys.append((int(digest[:5], 16) | 1, int(digest[5:15], 16) % (1 << bits)))
    return keys


def permuted(position: Column, total: int, seed: int, epoch: int) -> Column:
    """A keyed bijection of 0 .. total - 1, as arithmetic on each position.

    Rounds of multiplying, adding and shifting permute the numbers below a power of two less
    than twice as large (at most 2^40); a number that leaves the range walks on along its
    cycle, which brings it back.
    """
    bits = max(1, (total - 1).bit_length())
    if bits > 40:
        raise ValueError("at most 2^40 rows")
    size = 1 << bits

    def step(x: Column) -> Column:
        for factor, summand in _round_keys(seed, epoch, bits):
            x = (x * factor + summand).bitwiseAND(F.lit(size - 1))
            x = x.bitwiseXOR(F.shiftrightunsigned(x, (bits + 1) // 2))
        return x

    if total < 2:
        return position
    # One step for all, more only for those still outside.
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(position.cast("bigint")),
                       lambda x, _: F.when(x < total, x).otherwise(step(x)))


def number_rows(df: DataFrame, id_col: str, name: str = "row_no") -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of their ids: the one sort that all epochs share."""
    return with_position(df, [id_col], name)


def epoch_batches(
    numbered: DataFrame, total: int, batch_size: int, world_size: int = 1, epoch: int = 0, seed: int = 0,
    number_col: str = "row_no", drop_last: bool | None = None,
) -> DataFrame:
    """Numbered rows with ``pos``, ``rank``, ``batch`` and ``slot`` of a shuffled epoch.

    Nothing is sorted or shuffled: an epoch's position is a keyed permutation of the row's number. Dealt
    and dropped as in ``shard_batches``.
    """
    placed = numbered.withColumn("pos", permuted(F.col(number_col), total, seed, epoch))
    return _dealt(placed, total, batch_size, world_size, world_size > 1 if drop_last is None else drop_last)


def shard_batches(
    df: DataFrame, id_col: str, batch_size: int, world_size: int = 1, epoch: int = 0,
    seed: int = 0, shuffle: bool = True, drop_last: bool | None = None,
) -> DataFrame:
    """Rows with ``rank``, ``batch`` and ``slot``.

    The order is by id, or by a digest of seed, epoch and id when shuffled. Rows are dealt
    to the ranks in turn; with several ranks the first rows are dealt again until all
    have equally many, and by default the last partial batch of a shuffled epoch is dropped.
    """
    distributed = world_size > 1
    drop_last = (distributed and shuffle) if drop_last is None else drop_last
    keyed = df
    order = [id_col]
    if shuffle:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(id_col).cast("string")))
        keyed, order = df.withColumn("_digest", digest), ["_digest", id_col]
    placed = with_position(keyed, order, "pos").drop("_digest")
    return _dealt(placed, placed.count(), batch_size, world_size, drop_last)


def _dealt(placed: DataFrame, total: int, batch_size: int, world_size: int, drop_last: bool) -> DataFrame:
    """Rows at positions dealt to the ranks in turn."""
    per_rank = -(-total // world_size) if total else 0
    missing = per_rank * world_size - total
    if missing:
        again = F.expr(f"sequence(0L, {-(-missing // total)}L)")
        placed = (
            placed.withColumn("_turn", F.explode(again))
            .withColumn("pos", F.col("pos") + F.col("_turn") * total)
            .where(F.col("pos") < per_rank * world_size).drop("_turn")
        )
    in_rank = F.floor(F.col("pos") / world_size)
    out = (
        placed.withColumn("rank", (F.col("pos") % world_size).cast("int"))
        .withColumn("batch", F.floor(in_rank / batch_size))
        .withColumn("slot", (in_rank % batch_size).cast("int"))
    )
    return out.where(F.col("batch") < per_rank // batch_size) if drop_last else out
