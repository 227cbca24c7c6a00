"""Positions, batches, gating, metrics and a scored run."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import examples as E
from textloom.operators import gating as G
from textloom.operators import metrics as M
from textloom.operators import vocab as T
from textloom.operators.batches import epoch_batches, number_rows, permuted, shard_batches
from textloom.operators.chat import chat_pairs, chat_prompt
from textloom.operators.positions import with_position, with_running_totals
from textloom.plans.selfplay import score_solutions, score_tasks


def test_positions_and_totals(spark):
    df = spark.createDataFrame([((i * 37) % 101, i) for i in range(101)], "k long, v long").repartition(5)
    assert [r.pos for r in with_position(df, ["k"]).orderBy("k").collect()] == list(range(101))
    for inclusive in (True, False):
        rows = with_running_totals(df, ["k"], {"s": F.col("v")}, inclusive).orderBy("k").collect()
        total = 0
        for r in rows:
            assert r.s == total + (r.v if inclusive else 0)
            total += r.v


def test_empty_positions(spark):
    assert with_position(spark.range(0), ["id"]).count() == 0
    assert shard_batches(spark.range(0), "id", 4, 2).count() == 0


@pytest.mark.parametrize("n, world, size", [(10, 3, 2), (2, 5, 1), (12, 4, 3), (7, 1, 3)])
def test_batches(spark, n, world, size):
    rows = shard_batches(spark.range(n), "id", size, world, epoch=2, seed=1).collect()
    per_rank = -(-n // world)
    if world > 1:
        per_rank = per_rank // size * size
    for rank in range(world):
        mine = [r for r in rows if r["rank"] == rank]
        assert len(mine) == per_rank
        assert all(r.slot < size for r in mine)
    plain = shard_batches(spark.range(n), "id", size, world, shuffle=False).collect()
    assert {r.id for r in plain} == set(range(n))
    again = shard_batches(spark.range(n).repartition(3), "id", size, world, epoch=2, seed=1).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 1000, 4097])
def test_epochs_are_permutations(spark, n):
    got = spark.range(n).select("id", *[permuted(F.col("id"), n, 5, e).alias(f"e{e}") for e in range(3)]).collect()
    for e in range(3):
        assert sorted(r[f"e{e}"] for r in got) == list(range(n))
    if n > 100:
        moved = [[r[f"e{e}"] for r in got] for e in range(3)]
        assert moved[0] != moved[1] and abs(np.corrcoef(range(n), moved[0])[0, 1]) < .1
        assert sum(b == a + 1 for a, b in zip(moved[0], moved[0][1:])) < n / 50


def test_epochs_share_one_sort(spark):
    numbered = number_rows(spark.range(100).withColumn("text", F.lit("x")), "id")
    for epoch in (0, 1):
        out = epoch_batches(numbered, 100, 4, 3, epoch)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # Only the row counts of the partitions are brought together, never the rows.
        assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning(_part") == plan.count("Exchange hashpartitioning")
        assert sorted(out.groupBy("rank").count().collect()) == [(0, 32), (1, 32), (2, 32)]
    assert epoch_batches(number_rows(spark.range(0), "id"), 0, 4, 2).count() == 0


# --- vocabulary and examples

VOCAB = {"<pad>": 0, "<bos>": 1, "<eos>": 2, "<unk>": 3, "this": 4, "is": 5, "a": 6, "test": 7, "big": 90}


def vocab(spark, entries=VOCAB):
    return spark.createDataFrame(list(entries.items()), "token string, id long")


@pytest.mark.parametrize("in_memory", [1000, 0])
def test_lookup(spark, in_memory):
    df = spark.createDataFrame([(1, "this is  new"), (2, ""), (3, "big <pad>"), (4, None)], "doc_id int, t string")
    def ids(entries, **options):
        out = T.vocab_lookup(df, "t", vocab(spark, entries), max_in_memory=in_memory, **options)
        return [r.ids for r in out.orderBy("doc_id").collect()]
    assert ids(VOCAB) == [[4, 5, 3], [], [90, 0], None]
    assert ids(VOCAB, model_size=50) == [[4, 5, 3], [], [3, 0], None]
    assert ids({"this": 4}, unk=9) == [[4, 9, 9], [], [9, 9], None]


def test_size_of_a_vocabulary_changes_nothing(spark):
    from pyspark.sql import functions as F
    rows = [(1, ["a", None, "z"]), (2, ["a"]), (2, ["z", "z"]), (None, ["a", "a"]), (3, None), (4, [])]
    df = spark.createDataFrame(rows, "doc_id int, t array<string>").repartition(3)
    entries = [("a", 4), ("b", None), (None, 5), ("c", 6), ("c", 9), ("<unk>", 7)]
    table = spark.createDataFrame(entries, "token string, id long")
    def both(run):
        got = [sorted(map(repr, run(limit).collect())) for limit in (1000, 0)]
        assert got[0] == got[1]
        return got[0]
    ids = both(lambda limit: T.token_ids(df, F.col("t"), table, max_in_memory=limit).select("doc_id", "ids"))
    assert sorted(ids) == sorted(map(repr, T.token_ids(df, F.col("t"), table).select("doc_id", "ids").collect()))
    assert "Row(doc_id=1, ids=[4, 7, 7])" in ids and "Row(doc_id=None, ids=[4, 4])" in ids and "Row(doc_id=2, ids=[7, 7])" in ids
    spoken = spark.createDataFrame([(1, [4, 9, 0, 12]), (1, [4]), (None, [9]), (2, None), (3, [])], "doc_id int, ids array<int>")
    both(lambda limit: T.detokenize(spoken, "ids", table, max_in_memory=limit).select("doc_id", "text"))


@pytest.mark.parametrize("frequent, hot_rows", [(0, 1000), (6, 1)])
def test_large_vocabulary_joins_rare_words_only(spark, frequent, hot_rows):
    from pyspark.sql import functions as F
    rows = [(i, [f"w{(i * 7 + k) % 30}" if k % 5 else None for k in range(i % 12)]) for i in range(60)]
    rows += [(70, ["w1", "w1", "new", "w9", "new", "w9"]), (71, None), (72, []), (73, ["<unk>", "least"]), (70, ["far"])]
    df = spark.createDataFrame(rows, "doc_id int, t array<string>").repartition(4)
    entries = [(f"w{i}", i + 4) for i in range(0, 30, 2)] + [("w9", 1), ("w9", 40), ("least", -1), ("far", 1 << 30), ("<unk>", 3), ("x", None)]
    table = spark.createDataFrame(entries, "token string, id long")
    for model_size in (None, 20):
        want, got = [sorted(map(repr, T.token_ids(df, F.col("t"), table, model_size=model_size, **o).select("doc_id", "ids").collect()))
                     for o in ({}, {"max_in_memory": 0, "frequent": frequent, "hot_rows": hot_rows})]
        assert want == got
    spoken = T.token_ids(df, F.col("t"), table)
    want, got = [sorted(map(repr, T.detokenize(spoken, "ids", table, **o).select("doc_id", "text").collect()))
                 for o in ({}, {"max_in_memory": 0, "frequent": frequent, "hot_rows": hot_rows})]
    assert want == got


def test_join_of_a_large_vocabulary_moves_no_frequent_word(spark, monkeypatch):
    from pyspark.sql import functions as F
    sizes = []
    plain = T.join_per_key
    monkeypatch.setattr(T, "join_per_key", lambda rows, *a: sizes.append(rows.count()) or plain(rows, *a))
    df = spark.range(20).select(F.expr("split(repeat('a b c rare rare ', 50), ' ')").alias("t"))
    table = vocab(spark, {"<unk>": 3, "a": 4, "b": 5, "c": 6, "rare": 99, "": 7})
    found = T.token_ids(df, F.col("t"), table, max_in_memory=0, frequent=10)
    assert found.select(F.array_join(F.slice("ids", 1, 5).cast("array<string>"), " ").alias("x")).first().x == "4 5 6 99 99"
    T.detokenize(found, "ids", table, max_in_memory=0, frequent=10).count()
    assert sizes == [20, 20]


def test_vocab_checks(spark):
    def scan(text):
        return T.scan_vocab(spark.createDataFrame([(text,)], "value string"))
    assert {r.token: r.id for r in scan('{"tokens": ["a", "b", "a"]}').collect()} == {"a": 2, "b": 1}
    assert T.check_vocab(scan('{"a": 0, "b": 7}')) == 8
    assert T.check_vocab(scan("{}")) == 0
    for bad in ('{"a": 1, "b": 1}', '{"a": -1}', '{"a": "x"}', '{"a": "5"}', '{"a": 1.5}'):
        with pytest.raises(ValueError):
            T.check_vocab(scan(bad))


def example(spark, column):
    r = spark.range(1).select(column.alias("x")).first().x
    return r.input_ids, r.attention_mask, r.labels


def ids(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")


def test_pretrain_example(spark):
    assert example(spark, E.pretrain_example(ids(4, 0, 5), 5)) == ([4, 0, 5, 0, 0], [1, 0, 1, 0, 0], [4, -100, 5, -100, -100])
    assert example(spark, E.pretrain_example(ids(4, 5, 6), 2)) == ([4, 5], [1, 1], [4, 5])
    assert example(spark, E.pretrain_example(ids(), 2)) == ([0, 0], [0, 0], [-100, -100])


def test_sft_example(spark):
    assert example(spark, E.sft_example(ids(4, 5), ids(6), 6)) == (
        [4, 5, 6, 2, 0, 0], [1, 1, 1, 1, 0, 0], [-100, -100, 6, 2, -100, -100])
    assert example(spark, E.sft_example(ids(4, 5), ids(6, 7, 8), 4)) == ([4, 5, 6, 2], [1] * 4, [-100, -100, 6, 2])
    # pad and end mark share an id: only the closing mark keeps its label
    assert example(spark, E.sft_example(ids(4), ids(6), 5, pad=2, eos=2)) == (
        [4, 6, 2, 2, 2], [1, 1, 0, 0, 0], [-100, 6, 2, -100, -100])
    # a prompt that fills everything: the closing mark replaces its last id and is hidden
    assert example(spark, E.sft_example(ids(4, 5, 6, 7), ids(8), 3)) == ([4, 5, 2], [1] * 3, [-100] * 3)


def test_bos_and_detokenize(spark):
    row = spark.range(1).select(E.prepend_bos(ids(4)).alias("a"), E.prepend_bos(ids(1, 4)).alias("b"), E.prepend_bos(ids()).alias("c")).first()
    assert (row.a, row.b, row.c) == ([1, 4], [1, 4], [1])
    df = spark.createDataFrame([([1, 4, 77, 5, 2, 0],), ([],), (None,)], "ids array<int>")
    assert [r.text for r in T.detokenize(df, "ids", vocab(spark)).collect()] == ["this [<UNK>_ID:77] is", "", None]


# --- chat


def test_chat(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "hi"), (1, 2, "ASSISTANT", "yo"), (1, 3, "user", "bye"), (1, 4, "assistant", "ok"),
            (2, 0, "assistant", "alone")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = chat_prompt(df).collect()
    assert [(r.conv_id, r.turn) for r in got] == [(1, 3)]
    assert got[0].prompt == "System: S\nUser: hi\nAssistant: yo\nUser: bye\nAssistant:"
    assert [tuple(r) for r in chat_pairs(df).collect()] == [(1, 3, "bye", "ok")]


# --- gating and metrics


def checked(spark, rows):
    df = spark.createDataFrame(rows, "iteration int, seq int, type string, ok boolean")
    return df.withColumn("validation", F.struct(F.col("ok").alias("is_valid"), F.lit(None).cast("string").alias("reason")))


def test_forced_tasks(spark):
    rows = checked(spark, [(10, 1, "a", False), (11, 1, "a", False), (11, 2, "a", True)])
    got = [(r.is_valid, r.reason) for r in G.force_accept_tasks(rows).orderBy("iteration", "seq").select("validation.*").collect()]
    assert got == [(True, "Forced accept"), (False, None), (True, None)]


def test_forced_solutions(spark):
    tasks = checked(spark, [(1, s, "a", True) for s in range(20)] + [(2, 0, "a", True), (3, 0, "a", True), (4, 0, "a", True)])
    sols = checked(spark, [(i, 0, "a", False) for i in (1, 2, 3, 4)])
    got = [r.is_valid for r in G.force_accept_solutions(sols, tasks).orderBy("iteration").select("validation.is_valid").collect()]
    assert got == [True, True, False, False]  # 0, 20, 21, 22 accepted before


def test_draws(spark):
    df = spark.range(4000).select(F.lit(1).alias("iteration"), F.col("id").alias("seq"))
    seeds = spark.createDataFrame([("deduction", f"d{i}", i) for i in range(5)], "type string, task string, k int")
    rows = G.seed_or_generate(df, seeds, "k").collect()
    hot = G.seed_or_generate(df, seeds, "k", hot_rows=30).select(*df.columns, "type", "seed_task").collect()
    assert sorted(map(str, hot)) == sorted(
        str(r) for r in G.seed_or_generate(df, seeds, "k").select(*df.columns, "type", "seed_task").collect())
    share = {t: sum(r.type == t for r in rows) / 4000 for t in ("abduction", "deduction", "induction")}
    assert share == pytest.approx({"abduction": 0.3, "deduction": 0.3, "induction": 0.4}, abs=0.04)
    seeded = [r for r in rows if r.from_seed]
    assert {r.type for r in seeded} == {"deduction"} and {r.seed_task for r in seeded} == {f"d{i}" for i in range(5)}
    assert len(seeded) / (0.3 * 4000) == pytest.approx(0.2, abs=0.05)


def test_failed_generations_fall_back_to_seeds(spark):
    df = spark.range(600).select(F.lit(1).alias("iteration"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "What is the sum of two and two here?").alias("made"))
    seeds = spark.createDataFrame([("deduction", f"d{i}", i) for i in range(5)], "type string, task string, k int")
    rows = G.seed_or_generate(df, seeds, "k", generated="made", hot_rows=30).collect()
    assert len(rows) == 600 and {(r.from_seed, r.is_placeholder) for r in rows} == {(False, False), (True, False), (False, True)}
    for r in rows:
        if r.from_seed:
            assert r.type == "deduction" and r.task == r.seed_task
        elif r.made is None:
            assert r.type != "deduction" and r.is_placeholder and r.task.startswith(f"Create a simple {r.type} reasoning problem")
        else:
            assert r.task == r.made and not r.is_placeholder
    assert all(r.from_seed for r in rows if r.type == "deduction" and r.made is None)


def test_metrics_of_nothing(spark):
    empty = checked(spark, []).withColumn("rewards", F.create_map(F.lit("total"), F.lit(0.0)))
    got = {r.metric: r.value for r in M.run_summary(empty, empty).collect()}
    assert got["iterations"] == 0 and got["task_valid_rate"] == 0 and got["avg_validation_rates.tasks"] == 0


def test_ragged_averages(spark):
    df = spark.createDataFrame([({"a": 1.0, "total": 1.0},), ({"total": 0.0},)], "rewards map<string,double>")
    assert {r.key: r.average for r in M.avg_rewards_by_key(df).collect()} == {"a": 1.0, "total": 0.5}


def test_iteration_without_solutions_counts_zero(spark):
    tasks = checked(spark, [(1, 1, None, True), (2, 1, "x", False)]).withColumn("rewards", F.create_map(F.lit("total"), F.lit(1.0)))
    sols = checked(spark, [(1, 1, "x", True)]).withColumn("rewards", F.create_map(F.lit("total"), F.lit(1.0)))
    got = {r.metric: r.value for r in M.run_summary(tasks, sols).collect()}
    assert got["avg_validation_rates.solutions"] == 0.5 and got["task_types.unknown"] == 1


def test_scored_run(spark):
    text = "If a <= b and b <= 7, then what is the greatest value that a can take here, and why?"
    tasks = spark.createDataFrame(
        [(20, i, text if i < 2 else "Tiny words only are in this line.", "deduction", False, False) for i in range(3)],
        "iteration int, seq int, task string, type string, from_seed boolean, is_placeholder boolean")
    rows = {r.seq: r for r in score_tasks(tasks).collect()}
    assert rows[0].rewards["diversity"] == 1.0 and rows[1].rewards["diversity"] == 0.0
    assert rows[0].rewards["total"] == pytest.approx(sum(v for k, v in rows[0].rewards.items() if k != "total"))
    rejected = [r for r in rows.values() if not r.validation.is_valid]
    assert all(r.rewards == {"total": 0.0} for r in rejected)
    sols = spark.createDataFrame([(20, 0, text, "short", "short", False), (20, 1, text, "x", "x", True)],
                                 "iteration int, seq int, task string, solution string, raw_generation string, is_placeholder boolean")
    scored = {r.seq: r for r in score_solutions(sols, score_tasks(tasks)).collect()}
    assert scored[0].validation.reason == "Forced accept" and scored[0].rewards["accuracy"] == 0.0
    assert scored[1].rewards["total"] == pytest.approx(0.5 ** 1.5 + 1.5)
