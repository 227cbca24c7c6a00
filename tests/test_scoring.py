"""Scores against small mirrors written from their definitions."""
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import fixed_values as V
from textloom.functions import prompts as P
from textloom.functions import rewards as R
from textloom.functions import scoring as C
from textloom.functions.validation import validate_solution, validate_task
from textloom.functions.text import word_ngrams
from textloom.operators import nearest
from textloom.operators.diversity import NGRAM_WEIGHTS, closest_earlier_task
from textloom.operators.nearest import nearest_earlier

TEXTS = [
    "", " ", "one two three four", "Is a <= b, and if b != 3.5 then what is 2 + 3 * 4 = 14?",
    "```python\nprint(1)\n``` and ```x``` ``` ```", "The little table. Apple!! People; eye? " * 4,
    "First, we look. Therefore the cat sat on a mat today. The cat sat on another mat because tired. x.",
    "extraordinarily complicated considerations " * 60, "été 12 naïve 7e 1.2.3 a1 3.",
    "No stop here but many words follow each other without any end",
]


def values(spark, expression, texts=TEXTS):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def share(count, full):
    return min(1.0, count / full)


def complexity(text):
    words = text.lower().split()
    if not words:
        return 0.0
    blocks = [b for b in re.findall(r"```(?:python)?(.*?)```", text, re.S) if b.strip()]
    logic = sum(w in V.LOGIC_WORDS for w in words) + sum(map(text.count, V.COMPARISON_OPERATORS))
    return max(0.1, (
        0.15 * share(len(words), 150) + 0.2 * min(1, 1.5 * len({*words}) / len(words))
        + 0.15 * share(sum(len(w) > 8 for w in words), 10)
        + 0.15 * share(len(re.findall(r"\b\d+\.?\d*\b", text)), 8) + 0.2 * share(logic, 10)
        + 0.1 * share(sum(map(text.count, V.MATH_OPERATORS)), 8) + 0.05 * min(1, 0.5 * len(blocks))
    ))


def syllables(word):
    word = word.lower()
    runs = len(re.findall("[aeiouy]+", word)) - word.endswith("e")
    return max(1, runs + bool(re.search("[^aeiouy]le$", word)))


def clarity(text):
    sentences = sum(len(s.strip()) > 3 for s in re.split("[.!?]+", text))
    words = [w for w in (x.strip(V.ASCII_PUNCTUATION) for x in text.split()) if w]
    if len(words) < 5 or not sentences:
        return 0.0
    ease = 206.835 - 1.015 * len(words) / sentences - 84.6 * sum(map(syllables, words)) / len(words)
    return 0.85 * min(1, max(0, ease / 100)) + (0.15 if "?" in text else 0.105)


def content(text):
    return {*text.lower().split()} - {*V.STOP_WORDS}


def coherence(text):
    sets = [content(s) for s in re.split("[.!?]+", text) if len(s.split()) > 3]
    if len(sets) < 2:
        return 0.3
    links = sum(text.lower().count(t) for t in V.TRANSITIONS)
    near = [len(a & b) / len(a | b) for a, b in zip(sets, sets[1:]) if a and b]
    return 0.2 + 0.4 * share(links, len(sets) / 4) + 0.6 * (sum(near) / len(near) if near else 0)


@pytest.mark.parametrize("mirror, expression", [
    (complexity, C.complexity_score), (clarity, C.clarity_score), (coherence, C.coherence_score)])
def test_scores_match_mirror(spark, mirror, expression):
    assert values(spark, expression) == pytest.approx([mirror(t) for t in TEXTS], abs=1e-12)


def test_scores_of_conversations_match_mirror(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").collect()
    texts = [r.text for r in rows]
    for mirror, expression in ((complexity, C.complexity_score), (clarity, C.clarity_score), (coherence, C.coherence_score)):
        assert values(spark, expression, texts) == pytest.approx([mirror(t) for t in texts], abs=1e-9)


def test_syllables(spark):
    words = ["table", "apple", "the", "eye", "strength", "people", "le", "naïve", "queue"]
    assert values(spark, C.syllables, words) == [syllables(w) for w in words]


def test_structure(spark):
    texts = ["one line", "1. a\n2) b\n- c\n* d\n• e", "x\ny\n\nAnswer: z", "\n\n", "  3. x\nplain\nplain\nplain"]
    assert values(spark, C.structure_score, texts) == pytest.approx(
        [0.2, 1.0, 0.2 + 0.8 * min(1, 2 / 1.5), 0.2, 0.2 + 0.8 * 0.5])


def test_relevance(spark):
    df = spark.createDataFrame([("the cat sat", "a cat sat down"), ("the of", "x"), ("q", "z")], "a string, b string")
    got = [r.x for r in df.select(C.relevance_score(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == pytest.approx([min(1, 0.2 + 2 * 2 / 2), 0.5, 0.2])


# --- prompts and readers


def test_extract_task(spark):
    texts = ["Task: Find x in this equation.", "Task:Problem: nested names here", "short\nsecond\nthird\nfourth", "  ", "tiny", "Question: Why?"]
    assert values(spark, P.extract_task, texts) == [
        "Find x in this equation.", "nested names here", "short second third", None, "tiny", "Why?"]


def test_extract_answer(spark):
    texts = ["a <answer> 1\n2 </answer> <answer>3</answer>", "<answer></answer>", " plain ", "", "<answer>open"]
    assert values(spark, P.extract_answer, texts) == ["1\n2", None, "plain", None, "<answer>open"]


def test_code_blocks(spark):
    assert values(spark, P.extract_code_blocks, [TEXTS[4]]) == [["print(1)", "x"]]


def test_sft_prompt_template(spark):
    assert values(spark, lambda t: P.sft_prompt(t, "Q {instruction} A {output}"), ["{output}"]) == ["Q {output} A"]
    assert values(spark, lambda t: P.sft_prompt(t, "{instruction} only"), ["x"]) == ["User: x\nAssistant:"]
    assert values(spark, lambda t: P.sft_text(t, F.lit("{instruction}")), ["x"]) == ["User: x\nAssistant: {instruction}"]


def test_placeholders(spark):
    df = spark.createDataFrame([("induction",), ("other",), (None,)], "k string")
    rows = df.select(P.placeholder_solution(F.lit("t" * 70), F.col("k")).alias("x"), P.task_prompt(F.col("k")).alias("p")).collect()
    assert "'" + "t" * 60 + "...'" in rows[0].x and rows[1].x == V.PLACEHOLDER_SOLUTION_DEFAULT
    assert rows[1].p == V.TASK_PROMPT and rows[2].p == V.TASK_PROMPT


# --- validation


def verdict(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def task_verdict(spark, task, complexity=0.5, clarity=0.5, placeholder=False, seed=False):
    return verdict(spark, validate_task(F.lit(task).cast("string"), F.lit(placeholder), F.lit(seed), F.lit(complexity), F.lit(clarity)))


def test_validate_task(spark):
    assert task_verdict(spark, "x" * 14).reason == "Task too short"
    assert task_verdict(spark, "x" * 15).is_valid and task_verdict(spark, "x" * 2500).is_valid
    assert task_verdict(spark, "x" * 2501).reason == "Task too long"
    assert task_verdict(spark, None).reason == "Task too short"
    low = task_verdict(spark, "x" * 20, complexity=0.19)
    assert not low.is_valid and low.reason == "Failed metric thresholds" and low.complexity == 0.19
    assert task_verdict(spark, "x" * 20, clarity=0.1, seed=True).is_valid
    assert task_verdict(spark, "", placeholder=True).complexity == 0.5


def solution_verdict(spark, words, co=0.5, re_=0.5, st=0.5, placeholder=False, ran=None):
    executed = None if ran is None else F.lit(ran)
    return verdict(spark, validate_solution(F.lit(" ".join(["w"] * words)), F.lit(placeholder), F.lit(co), F.lit(re_), F.lit(st), executed))


def test_validate_solution(spark):
    assert solution_verdict(spark, 0).reason == "Empty solution"
    assert solution_verdict(spark, 9).reason == "Solution too short"
    assert solution_verdict(spark, 10).is_valid
    assert not solution_verdict(spark, 49, co=0.3).is_valid
    assert solution_verdict(spark, 50, co=0.3).is_valid
    assert solution_verdict(spark, 0, placeholder=True).correctness == 0.5


def test_validate_executed_solution(spark):
    good = solution_verdict(spark, 20, ran=True)
    assert good.is_valid and good.correctness == 0.8
    bad = solution_verdict(spark, 60, ran=False)
    assert not bad.is_valid and bad.correctness == 0.25
    assert solution_verdict(spark, 60, 0.9, 0.9, 0.9, ran=False).is_valid
    short = solution_verdict(spark, 5, ran=True)
    assert short.is_valid and short.correctness == 0.8 and short.coherence is None
    assert not solution_verdict(spark, 5, ran=False).is_valid


# --- rewards and diversity


def test_rewards(spark):
    row = spark.range(1).select(
        R.reward_complexity(F.lit(0.55)).alias("c"), R.reward_complexity(F.lit(None).cast("double")).alias("n"),
        R.reward_accuracy(F.lit(True), F.lit(0.25), weight=2.0).alias("a"),
        R.reward_accuracy(F.lit(False), F.lit(0.9)).alias("i"),
        R.reward_map({"a": F.lit(0.5), "b": F.lit(0.25)}, ["b", "x", "a"]).alias("m"),
        R.reward_total(R.reward_map({"a": F.lit(0.5), "b": F.lit(0.25)}, ["a", "b"])).alias("t"),
    ).first()
    assert row.c == pytest.approx(math.exp(-0.5)) and row.n == pytest.approx(math.exp(-0.49 / 0.045))
    assert row.a == 0.25 and row.i == 0.0
    assert row.m == {"b": 0.25, "a": 0.5, "total": 0.75} and row.t == 0.75


def grams(text, n):
    words = text.lower().split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def likeness(a, b):
    total = 0.0
    for n, weight in ((1, 0.2), (2, 0.4), (3, 0.4)):
        x, y = grams(a, n), grams(b, n)
        total += weight * (len(x & y) / len(x | y) if x | y else 1.0)
    return total


@pytest.mark.parametrize("bundle, hot, short, block", [(64, 1000, 32, 4096), (2, 1, 32, 4096), (1, 3, 2, 5), (1, 1000, 4, 7)])
def test_closest_earlier_task(spark, bundle, hot, short, block):
    words = ["red", "blue", "green", "up", "down", "left"]
    rows = []
    for i in range(40):
        text = " ".join(words[(i * k) % 6] for k in range(1, 1 + (i * 7) % 6))
        rows.append((i % 3 if i < 30 else 0, 100 - i, text))
    rows += [(7, 1, "lonely"), (8, 1, ""), (8, 2, " "), (8, 3, None), (9, 5, "a b"), (9, 4, "c d")]
    want = {}
    for it, seq, text in rows:
        earlier = [(likeness(text or "", t or ""), -s) for i, s, t in rows if i == it and s < seq]
        best = max(earlier) if earlier else None
        want[(it, seq)] = best
    df = spark.createDataFrame(rows, "iteration int, seq int, task string")
    got = closest_earlier_task(df, bundle=bundle, hot_rows=hot, short=short, block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        best = want[(r.iteration, r.seq)]
        if best is None:
            assert r.max_similarity is None and r.closest_seq is None
        else:
            assert r.max_similarity == pytest.approx(best[0])
            assert likeness_of(rows, r.iteration, r.seq, r.closest_seq) == pytest.approx(best[0])


def variants(groups):
    """Members of one group: texts of rare and common words, each followed by near copies of it."""
    draw, rows = random.Random(groups), []
    for g in range(groups):
        text = [f"r{g}x{k}" if draw.random() < .4 else draw.choice("the of and to in is it for on as at by".split()) for k in range(25)]
        for _ in range(4):
            copy = list(text)
            copy[draw.randrange(25)] = draw.choice(["the", "of", "new"])
            rows.append((1, len(rows), " ".join(copy)))
    return rows


def test_comparisons_stay_flat_as_an_iteration_grows(spark):
    """Ten times the tasks: as many comparisons a task, and the same results as bundles give."""
    per_task = []
    for groups in (40, 400):
        df = spark.createDataFrame(variants(groups), "grp bigint, place bigint, words string").dropDuplicates(["words"])
        sets = [word_ngrams(F.split("words", " "), n).alias(f"g{n}") for n in (1, 2, 3)]
        found = nearest_earlier(df.select("*", *sets), NGRAM_WEIGHTS).cache()
        per_task.append(found.agg(F.avg("compared")).first()[0])
        if groups == 40:
            want = closest_earlier_task(df, "grp", "place", "words", bundle=10_000).collect()
            got = {r.place: (r.similarity, r.prev) for r in found.collect()}
            assert got == {r.place: (r.max_similarity, r.closest_seq) for r in want}
    assert 0 < per_task[1] < 1.2 * per_task[0] < 12


def test_search_writes_no_rows_per_pair(spark, monkeypatch):
    """Many blocks and chunks: tables hold at most a row per member, are removed, and the results are those of bundles."""
    rows = variants(60)
    rows = list({(g, w): (g, p, w) for g, p, w in rows + [(2, p, w + " second group") for _, p, w in rows]}.values())
    df = spark.createDataFrame(rows, "grp bigint, place bigint, words string")
    sizes, files, stored = {}, [], nearest.stored

    def kept(table, name):
        out = stored(table, name)
        sizes[name] = max(out.count(), sizes.get(name, 0))
        files.append((name, out.inputFiles()[0].removeprefix("file:").replace("//", "/")))
        return out

    monkeypatch.setattr(nearest, "stored", kept)
    monkeypatch.setattr(nearest, "CHUNK", 1000)
    sets = [word_ngrams(F.split("words", " "), n).alias(f"g{n}") for n in (1, 2, 3)]
    found = {(r.grp, r.place): (r.similarity, r.prev) for r in nearest_earlier(df.select("*", *sets), NGRAM_WEIGHTS, short=8, block=16).collect()}
    want = closest_earlier_task(df, "grp", "place", "words", bundle=10_000).collect()
    assert found == {(r.grp, r.place): (r.max_similarity, r.closest_seq) for r in want}
    members = df.count()
    assert members > 16 * 16 and all(n <= members for name, n in sizes.items() if name not in ("shared", "ranked"))
    assert sum(name == "pass" for name, _ in files) > 4
    assert {name for name, file in files if os.path.exists(file)} == {"nearest"}


def likeness_of(rows, it, seq, other):
    text = {(i, s): t or "" for i, s, t in rows}
    return likeness(text[(it, seq)], text[(it, other)])


def test_settings_and_outcomes_of_a_run(spark):
    from textloom.plans.selfplay import RunSettings, score_solutions, score_tasks
    task = "If every even number above 12 is the sum of two primes, then which pairs give 48, and why?"
    rows = [(11, i, task + f" Case {i}.", kind, False, False, score) for i, (kind, score) in enumerate(
        [("induction", 0.0), ("deduction", 0.0), ("induction", None)])]
    tasks = spark.createDataFrame(rows, "iteration int, seq int, task string, type string, from_seed boolean, "
                                  "is_placeholder boolean, execution_score double")
    settings = RunSettings(weights={"clarity": 2.0, "diversity": 0.0}, task_limits={"min_clarity": 0.0, "min_complexity": 0.0})
    plain = {r.seq: r for r in score_tasks(tasks, settings=RunSettings(task_limits=settings.task_limits)).collect()}
    weighed = {r.seq: r for r in score_tasks(tasks, settings=settings).collect()}
    assert [plain[i].validation.executability for i in range(3)] == [0.0, 1.0, 1.0]
    assert weighed[0].rewards["clarity"] == 2 * plain[0].rewards["clarity"] and weighed[0].rewards["diversity"] == 0
    # Iterations of a resumed run count on.
    strict = {"min_clarity": 1.1}
    assert not score_tasks(tasks, settings=RunSettings(task_limits=strict)).first().validation.is_valid
    early = tasks.withColumn("iteration", F.lit(1))
    assert score_tasks(early, settings=RunSettings(task_limits=strict)).first().validation.is_valid
    assert not score_tasks(early, settings=RunSettings(task_limits=strict, iterations_before=10)).first().validation.is_valid
    words = " ".join(["word"] * 20)
    solutions = spark.createDataFrame(
        [(1, i, "task", kind, words, words, False, ran) for i, (kind, ran) in enumerate([("induction", True), ("deduction", True), ("induction", False)])],
        "iteration int, seq int, task string, type string, solution string, raw_generation string, is_placeholder boolean, executed boolean")
    checked = score_tasks(tasks)
    got = {r.seq: r.validation for r in score_solutions(solutions, checked, settings=RunSettings(force_solutions=False)).collect()}
    assert got[0].is_valid and not got[1].is_valid and got[2].reason == "Execution failed, heuristic score penalized"
    # More tasks accepted before than the limit: nothing is forced any more.
    assert score_solutions(solutions, checked).where("seq = 1").first().validation.is_valid
    assert not score_solutions(solutions, checked, settings=RunSettings(valid_tasks_before=21)).where("seq = 1").first().validation.is_valid
