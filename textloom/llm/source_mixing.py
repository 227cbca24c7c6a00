"""Mixing sources to target weights: Sainte-Laguë seats for sources and shards, then blocks of words."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.blocks import stored
from textloom.operators.positions import with_position, with_running_totals

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixRule:
    """Weights of the sources in code point order, repeating; how often a word may be taken."""

    weights: tuple[int, ...] = (1, 2, 3)
    repeats: int = 3
    # Words of a block: a quota is a number of blocks. Blocks never become rows, so their size
    # costs nothing, and small ones bring small tables close to their targets.
    block_words: int = 16
    # A shard holds about so many words and rows, whatever the input; a cell is one source's part of it.
    shard_words: int = 1 << 22
    shard_rows: int = 1 << 16
    seed: str = "mix"


def apportion(parties: DataFrame, group: Sequence[str], party: Sequence[str], votes: str, seats: str, limit: str) -> DataFrame:
    """``parties`` with ``won``: the seats of each by the highest quotients votes / (2k + 1).

    ``seats`` is the same for all rows of a group. Equal quotients go by the order of
    ``party``. Votes are positive. Seats that a party wins beyond its ``limit`` stay free. With m parties, the divisors votes / (seats ± m/2) give at most and at least
    all seats: every quotient above the first is a seat, none below the second is, and only
    the at most 3m between them are ranked. Ranks come from positions over all groups
    at once, so no group is brought into one task.
    """
    sums = parties.groupBy(*group).agg(F.sum(votes).alias("_votes"), F.count(F.lit(1)).alias("_m"))

    share = F.col(votes) / F.col("_votes")
    ranged = stored(parties.join(sums, list(group)).withColumns({
        "_base": F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_m") / 2) + .5)).cast("bigint"),
        # One more than needed, for the rounding of large products.
        "_top": F.floor(share * (F.col(seats) + F.col("_m") / 2) + 1.5).cast("bigint"),
    }).drop("_votes", "_m"), "ranged")
    left = ranged.groupBy(*group).agg((F.first(seats) - F.sum("_base")).alias("_left"))
    between = ranged.where("_top > _base").select(
        *group, *party, F.col(votes).alias("_v"), F.explode(F.sequence("_base", F.col("_top") - 1)).alias("_k"))
    ranks = with_position(
        between.select(*group, (-F.col("_v") / (2 * F.col("_k") + 1)).alias("_lower"), *party, "_k"),
        [*group, "_lower", *party, "_k"], "_pos")
    start = ranks.groupBy(*group).agg(F.min("_pos").alias("_first")).join(left, list(group))
    more = ranks.join(start, list(group)).where("_pos - _first < _left").groupBy(*group, *party).agg(F.count(F.lit(1)).alias("_more"))
    return ranged.join(more, [*group, *party], "left").withColumn(
        "won", F.least(F.col("_base") + F.coalesce("_more", F.lit(0)), F.col(limit))).drop("_base", "_top", "_more")


def source_targets(sources: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """(key, source_size, target) from (key, source_size): words of each source in the mix.

    Sources are filled in proportion to their weights, up to ``repeats`` times their size,
    and what that leaves over goes to the others. In ascending order of limit / weight a source
    is full exactly if its limit is at most its share of what the ones before it leave.
    """
    weights = F.array(*map(F.lit, rule.weights))
    weighed = with_position(sources, ["key"]).select(
        "key", "source_size", (F.col("source_size") * rule.repeats).alias("most"),
        weights[(F.col("pos") % len(rule.weights)).cast("int")].cast("bigint").alias("weight"))
    all_words, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    before = with_running_totals(
        weighed.withColumn("level", F.col("most") / F.col("weight")), ["level", "key"],
        {"most_before": F.col("most"), "weight_before": F.col("weight")}, inclusive=False)
    filled = stored(before.withColumn(
        "full", F.col("most") * (F.lit(all_weights) - F.col("weight_before")).cast("double")
        <= F.col("weight") * (F.lit(all_words) - F.col("most_before")).cast("double")), "filled")
    used, weight = filled.agg(F.sum(F.when(F.col("full"), F.col("most"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    share = F.col("weight") * F.lit((all_words or 0) - (used or 0)) / F.lit(weight or 1)
    return filled.select("key", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def _drawn(text: Column) -> Column:
    """A number below 2^32 from the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _chosen_before(word: str, width: int) -> str:
    """SQL for the words of chosen blocks before a word of a cell.

    ``extra`` of ``blocks`` blocks are chosen at equal distances from a seeded ``first``:
    (j * extra + first) div blocks of them lie before block j, so no block becomes a row.
    """
    def chosen(j: str) -> str:
        return f"(({j}) * extra + first) div blocks"

    block = f"(({word}) div {width})"
    return f"({width} * ({chosen(block)}) + ({word}) % {width} * ({chosen(block + ' + 1')} - {chosen(block)}))"


def mix_sources(
    docs: DataFrame, rule: MixRule = MixRule(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, passes, spans), one row per row of ``docs``.

    ``size`` counts words, ``target`` are the words the mix should hold of the row's source,
    ``taken`` those it takes of the row: the whole text ``passes`` times, and once more
    the ``spans`` (start and end words, from 0). Rows are dealt to shards by a seeded hash of
    their id, so that a source of any size is spread over all of them. The blocks of the mix
    are apportioned to the sources, each source's blocks to its shards, and a shard takes its
    quota of a source from the source's blocks there, in seeded order. Shards hold about
    ``shard_words`` words; only they, never whole sources, are sorted.

    A null text has no words; words are runs without ASCII white space. A null source is a
    source of its own, the last one. The same rows always give the same mix, in whatever
    order they come; rows that repeat an id share its place, one after the other. A null id
    hashes like an empty one. An empty table, and a table without a word, takes nothing. Other
    columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("2"))
    sizes = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("draw"),
    ), "sizes")
    words, rows = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-words // rule.shard_words), -(-rows // rule.shard_rows))
    placed = sizes.withColumn("shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint") % shards)
    width = rule.block_words
    cells = stored(placed.groupBy("key", "shard").agg(F.sum("size").alias("cell_size"))
                   .withColumn("blocks", F.ceil(F.col("cell_size") / width)), "cells")
    per_source = cells.groupBy("key").agg(F.sum("cell_size").alias("source_size"), F.sum("blocks").alias("source_blocks"))
    targets = stored(source_targets(per_source.select("key", "source_size"), rule), "targets")
    quotas = apportion(
        targets.join(per_source.drop("source_size"), "key").where("target > 0").withColumns({
            "mix": F.lit(0), "seats": F.lit(round(words / width)).cast("bigint"), "most": F.col("source_blocks") * rule.repeats}),
        ["mix"], ["key"], "target", "seats", "most")
    held = apportion(
        cells.where("cell_size > 0").join(quotas.select("key", F.col("won").alias("seats")), "key")
        .withColumn("most", F.col("blocks") * rule.repeats),
        ["key"], ["shard"], "cell_size", "seats", "most")
    plan = cells.select("key", "shard", F.greatest("blocks", F.lit(1)).alias("blocks")).join(targets, "key").join(
        held.select("key", "shard", "won"), ["key", "shard"], "left"
    ).withColumns({
        "passes": F.expr("coalesce(won, 0) div blocks"), "extra": F.expr("coalesce(won, 0) % blocks"),
        "first": _drawn(F.concat_ws(":", F.lit(rule.seed), "key", F.col("shard").cast("string"))) % F.col("blocks"),
    }).drop("won")
    order = Window.partitionBy("key", "shard").orderBy("draw", "doc_id", "size")
    rows = placed.withColumn("begin", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    spans = F.expr(f"""transform(
        filter(if(size > 0, sequence(begin div {width}, (begin + size - 1) div {width}), array()),
               j -> ((j + 1) * extra + first) div blocks > (j * extra + first) div blocks),
        j -> named_struct('start', greatest(j * {width}, begin) - begin, 'end', least((j + 1) * {width}, begin + size) - begin))""")
    more = F.expr(f"{_chosen_before('begin + size', width)} - {_chosen_before('begin', width)}")
    return rows.join(plan, ["key", "shard"]).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + more).alias("taken"), "passes",
        spans.alias("spans"))


def mixed_texts(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, text): what ``mix_sources`` takes, whole texts first, then each span's words joined by a blank.

    Ids name one row each here; rows without an id are left out. Texts of which nothing is
    taken give no row.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("whole"))
    taken = mix.where("taken > 0").select("doc_id", "passes", "spans").join(texts, "doc_id")
    words = F.regexp_extract_all("whole", F.lit(f"({WORD})"), F.lit(1))
    pieces = F.concat(
        F.array_repeat(F.col("whole"), F.col("passes").cast("int")),
        F.when(F.size("spans") > 0, F.transform("spans", lambda s: F.array_join(
            F.slice(words, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), " "))).otherwise(F.array()))
    return taken.select("doc_id", F.posexplode(pieces).alias("piece", "text"))
