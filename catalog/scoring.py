"""Queries over tasks, solutions, rewards and run metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog import sql as S
from textloom.functions import prompts as P
from textloom.functions import rewards as R
from textloom.functions import scoring as C
from textloom.functions.text import blank_words, jaccard, word_ngrams
from textloom.operators import diversity as D
from textloom.operators import gating as G
from textloom.operators import metrics as M
from textloom.operators.execution import execution_outcome
from textloom.operators.storage import cut
from textloom.plans.selfplay import (
    score_solutions, score_tasks, validated_solutions, validated_tasks,
)

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.replace(", 6)", " + 1e-9, 6)")
        return run
    return register


def r6(column):
    """Six places; the shift keeps short decimals off the rounding boundary."""
    return F.round(column + 1e-9, 6)


def rounded(df, *names):
    return df.select(*[r6(F.col(c)).alias(c) if c in names else c for c in df.columns])


# --- prompts and readers ---------------------------------------------------------------

TYPED = S.with_(S.TASKS)


@query("task_prompt", TYPED + "SELECT seq, " + S.lit(P.TASK_PROMPT) + " || CASE type " + " ".join(
    f"WHEN '{t}' THEN {S.lit(x)}" for t, x in P.TASK_PROMPT_SUFFIX.items()) + " ELSE '' END AS prompt FROM tasks")
def _(spark, sf):
    return B.typed_turns(spark, sf).select("seq", P.task_prompt(F.col("type")).alias("prompt"))


@query("solution_prompt", TYPED + f"""SELECT seq, {S.lit(P.SOLUTION_PROMPT)} || ' This is a ' || type
  || ' reasoning problem.' || chr(10) || chr(10) || '### Problem ###' || chr(10) || task || chr(10)
  || chr(10) || '### Solution ###' AS prompt FROM tasks""")
def _(spark, sf):
    return B.tasks(spark, sf).select("seq", P.solution_prompt(F.col("task"), F.col("type")).alias("prompt"))


@query("extract_task", TYPED + "SELECT seq, found AS task FROM tasks")
def _(spark, sf):
    return B.typed_turns(spark, sf).select("seq", P.extract_task(F.col("raw")).alias("task"))


@query("expand_short_task", TYPED + f"SELECT seq, {S.short_task('found', 'type')} AS task FROM tasks WHERE found IS NOT NULL")
def _(spark, sf):
    return B.tasks(spark, sf).where("found is not null").select(
        "seq", P.expand_short_task(F.col("found"), F.col("type")).alias("task"))


@query("extract_answer", TYPED[:-1] + ",\n" + S.SOLUTIONS + """
  SELECT r.conv_id, r.turn, """ + S.extract_answer("raw_generation") + " AS answer FROM raw_solutions r")
def _(spark, sf):
    return B.raw_solutions(spark, sf).select(
        "conv_id", "turn", P.extract_answer(F.col("raw_generation")).alias("answer"))


@query("extract_code_blocks", S.with_(S.TASKS, S.SOLUTIONS) + f"""
  SELECT conv_id, turn, len({S.code_blocks('raw_generation')})::BIGINT AS n,
    array_to_string({S.code_blocks('raw_generation')}, '|') AS blocks FROM raw_solutions
  UNION ALL SELECT conv_id, turn, len({S.code_blocks('raw')})::BIGINT,
    array_to_string({S.code_blocks('raw')}, '|') FROM tasks""")
def _(spark, sf):
    texts = B.raw_solutions(spark, sf).select("conv_id", "turn", F.col("raw_generation").alias("t")).unionByName(
        B.typed_turns(spark, sf).select("conv_id", "turn", F.col("raw").alias("t")))
    blocks = P.extract_code_blocks(F.col("t"))
    return texts.select("conv_id", "turn", F.size(blocks).cast("long").alias("n"),
                        F.array_join(blocks, "|").alias("blocks"))


@query("placeholder_fill", S.with_(S.TASKS, S.SOLUTIONS) + """
  SELECT seq, 'task' AS kind, task AS text, is_placeholder FROM tasks
  UNION ALL SELECT seq, 'solution', solution, is_placeholder FROM solutions""")
def _(spark, sf):
    return B.tasks(spark, sf).select("seq", F.lit("task").alias("kind"), F.col("task").alias("text"), "is_placeholder").unionByName(
        B.solutions(spark, sf).select("seq", F.lit("solution").alias("kind"), F.col("solution").alias("text"), "is_placeholder"))


# --- scores ----------------------------------------------------------------------------


@query("complexity_score", TYPED + f"SELECT seq, round({S.complexity('task')}, 6) AS complexity FROM tasks")
def _(spark, sf):
    return B.tasks(spark, sf).select("seq", r6(C.complexity_score(F.col("task"))).alias("complexity"))


@query("clarity_score", TYPED + f"SELECT seq, round({S.clarity('task')}, 6) AS clarity FROM tasks")
def _(spark, sf):
    return B.tasks(spark, sf).select("seq", r6(C.clarity_score(F.col("task"))).alias("clarity"))


@query("syllables", f"""SELECT w AS word, count(*) AS n, {S.syllables('w')}::BIGINT AS syllables FROM (
  SELECT unnest({S.words('text')}) AS w FROM documents) GROUP BY w""")
def _(spark, sf):
    docs = B.spread(B.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select(F.explode_outer(blank_words(F.col("text"))).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    return words.withColumn("syllables", C.syllables(F.col("word")).cast("long"))


SOLVED = S.with_(S.TASKS, S.SOLUTIONS)


@query("coherence_score", SOLVED + "SELECT seq, round(coherence, 6) AS coherence FROM ("
       + S.coherence("solutions", "seq", "solution") + ")")
def _(spark, sf):
    return B.solutions(spark, sf).select("seq", r6(C.coherence_score(F.col("solution"))).alias("coherence"))


@query("relevance_score", SOLVED + f"SELECT seq, round({S.relevance('task', 'solution')}, 6) AS relevance FROM solutions")
def _(spark, sf):
    return B.solutions(spark, sf).select(
        "seq", r6(C.relevance_score(F.col("task"), F.col("solution"))).alias("relevance"))


@query("structure_score", SOLVED + f"SELECT seq, round({S.structure('raw_generation')}, 6) AS structure FROM solutions")
def _(spark, sf):
    return B.solutions(spark, sf).select(
        "seq", r6(C.structure_score(F.col("raw_generation"))).alias("structure"))


@query("set_jaccard", SOLVED + f"""SELECT seq, round({S.jaccard(S.content('task'), S.content('solution'))}, 6) AS jaccard,
  len({S.content('task')})::BIGINT AS task_words FROM solutions""")
def _(spark, sf):
    a, b = C.content_words(F.col("task")), C.content_words(F.col("solution"))
    return B.solutions(spark, sf).select(
        "seq", r6(jaccard(a, b)).alias("jaccard"), F.size(a).cast("long").alias("task_words"))


@query("ngrams", TYPED + "SELECT seq, " + ", ".join(
    f"len({S.gram_set('task', n)})::BIGINT AS n{n}, md5(array_to_string(list_sort({S.gram_set('task', n)}), '|')) AS d{n}"
    for n in (1, 2, 3)) + " FROM tasks")
def _(spark, sf):
    words = blank_words(F.lower(F.col("task")))
    out = ["seq"]
    for n in (1, 2, 3):
        grams = word_ngrams(words, n)
        out += [F.size(grams).cast("long").alias(f"n{n}"),
                F.md5(F.array_join(F.array_sort(grams), "|")).alias(f"d{n}")]
    return B.tasks(spark, sf).select(*out)


# --- validation and gating -------------------------------------------------------------

# No task here has a run, so every one with scores is executable.
TASK_FIELDS = ("iteration, seq, is_valid, round(complexity, 6) AS complexity, round(clarity, 6) AS clarity,"
               " CASE WHEN complexity IS NOT NULL THEN 1.0::DOUBLE END AS executability, reason")


def flat(df, *keys):
    return df.select(*keys, "validation.*")


@query("validate_task", S.with_(S.TASKS, S.VALIDATED_TASKS) + f"SELECT {TASK_FIELDS} FROM validated")
def _(spark, sf):
    out = flat(validated_tasks(B.tasks(spark, sf), force=False), "iteration", "seq")
    return rounded(out, "complexity", "clarity")


@query("force_accept_tasks", S.with_(S.TASKS, S.VALIDATED_TASKS, S.ACCEPTED_TASKS)
       + "SELECT iteration, seq, is_valid, reason FROM gated")
def _(spark, sf):
    return validated_tasks(B.tasks(spark, sf)).select(
        "iteration", "seq", "validation.is_valid", "validation.reason")


# A code block's run is a row of a given table; here a digest decides how the run ended.
RUNS = f"""blocks AS (SELECT seq, unnest(range(1, len({S.code_blocks('solution')}) + 1)) AS block_no
    FROM solutions),
runs AS (SELECT seq, block_no, substr(md5('x:' || seq || ':' || block_no), 1, 1) NOT IN ('0', '1', '2', '3', '4', '5') AS success
    FROM blocks)"""


def code_runs(sol):
    blocks = sol.select("seq", F.posexplode(P.extract_code_blocks(F.col("solution"))).alias("pos", "code"))
    numbered = blocks.select("seq", (F.col("pos") + 1).alias("block_no"))
    return numbered.withColumn(
        "success", ~F.substring(B.digest("x", "seq", "block_no"), 1, 1).isin(*"012345"))


@query("execution_outcome", S.with_(S.TASKS, S.SOLUTIONS, RUNS) + """
  SELECT s.seq, bool_and(r.success) AS executed, CASE WHEN bool_and(r.success) IS NULL THEN 0.5::DOUBLE
    WHEN bool_and(r.success) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS execution_score
  FROM solutions s LEFT JOIN runs r USING (seq) GROUP BY s.seq""")
def _(spark, sf):
    sol = B.solutions(spark, sf)
    return execution_outcome(sol.select("seq"), code_runs(sol), ["seq"])


SOL_FIELDS = ("is_valid, round(correctness, 6) AS correctness, round(coherence, 6) AS coherence,"
              " round(relevance, 6) AS relevance, round(structure, 6) AS structure, reason")
SCORES = ("correctness", "coherence", "relevance", "structure")


@query("validate_solution", S.with_(S.TASKS, S.SOLUTIONS, S.VALIDATED_SOLUTIONS, RUNS, """
executed AS (SELECT seq, bool_and(success) AS ok FROM runs GROUP BY seq),
ran AS (SELECT v.*, CASE WHEN v.type = 'induction' AND NOT v.is_placeholder THEN e.ok END AS ok
  FROM sol_validated v LEFT JOIN executed e USING (seq)),
adjusted AS (SELECT * REPLACE (
    CASE WHEN ok IS NULL THEN correctness WHEN ok THEN greatest(correctness, 0.8) ELSE correctness * 0.5 END AS correctness,
    CASE WHEN ok IS NULL THEN is_valid WHEN ok THEN true ELSE correctness * 0.5 >= 0.4 END AS is_valid,
    CASE WHEN ok IS NULL THEN reason WHEN ok THEN 'Execution successful, combined with heuristics'
      ELSE 'Execution failed, heuristic score penalized' END AS reason) FROM ran)""")
       + f"SELECT seq, {SOL_FIELDS} FROM adjusted")
def _(spark, sf):
    sol = B.solutions(spark, sf)
    ran = execution_outcome(sol, code_runs(sol), ["seq"])
    return rounded(flat(validated_solutions(ran), "seq"), *SCORES)


def checked_tasks(spark, sf):
    return validated_tasks(B.tasks(spark, sf))


def accepted_solutions(spark, sf, checked):
    return B.solutions(spark, sf, checked.where("validation.is_valid"))


@query("force_accept_solutions", S.ALL_SOLUTIONS + "SELECT iteration, seq, is_valid, reason FROM sol_gated")
def _(spark, sf):
    checked = cut(checked_tasks(spark, sf))
    out = score_solutions(accepted_solutions(spark, sf, checked), checked)
    return out.select("iteration", "seq", "validation.is_valid", "validation.reason")


# --- diversity -------------------------------------------------------------------------

ACCEPTED = S.with_(S.TASKS, S.VALIDATED_TASKS, S.ACCEPTED_TASKS, S.closest("(SELECT * FROM gated WHERE is_valid)"))


def closest(spark, sf):
    return D.closest_earlier_task(cut(checked_tasks(spark, sf)).where("validation.is_valid"))


@query("diversity_pairs", S.with_(S.TASKS, S.closest("tasks"))
       + "SELECT iteration, seq, closest_seq, round(max_similarity, 6) AS similarity FROM closest")
def _(spark, sf):
    return D.closest_earlier_task(B.tasks(spark, sf)).select(
        "iteration", "seq", "closest_seq", r6(F.col("max_similarity")).alias("similarity"))


@query("diversity_pairs_large", S.with_(S.TASKS, S.closest("(SELECT * REPLACE (CAST(1 AS BIGINT) AS iteration) FROM tasks)"))
       + "SELECT iteration, seq, closest_seq, round(max_similarity, 6) AS similarity FROM closest")
def _(spark, sf):
    """The whole table as one iteration, searched by inverted lists."""
    tasks = B.tasks(spark, sf).withColumn("iteration", F.lit(1).cast("bigint"))
    return D.closest_earlier_task(tasks, bundle=64).select(
        "iteration", "seq", "closest_seq", r6(F.col("max_similarity")).alias("similarity"))


@query("max_prior_similarity", ACCEPTED + "SELECT iteration, seq, round(max_similarity, 6) AS max_similarity FROM closest")
def _(spark, sf):
    return rounded(closest(spark, sf).drop("closest_seq"), "max_similarity")


@query("reward_diversity", ACCEPTED + "SELECT iteration, seq, round(1 - coalesce(max_similarity, 0), 6) AS reward FROM closest")
def _(spark, sf):
    return closest(spark, sf).select(
        "iteration", "seq", r6(R.reward_diversity(F.col("max_similarity"))).alias("reward"))


# --- rewards ---------------------------------------------------------------------------


@query("reward_complexity", S.with_(S.TASKS, S.VALIDATED_TASKS)
       + "SELECT seq, round(exp(-((coalesce(complexity, 0.0) - 0.7) ** 2) / (2 * 0.15 ** 2)), 6) AS reward FROM validated")
def _(spark, sf):
    return validated_tasks(B.tasks(spark, sf), force=False).select(
        "seq", r6(R.reward_complexity(F.col("validation.complexity"))).alias("reward"))


SOLUTION_CHECKS = S.with_(S.TASKS, S.SOLUTIONS, S.VALIDATED_SOLUTIONS)


def checked_solutions(spark, sf):
    return validated_solutions(B.solutions(spark, sf))


@query("reward_linear", SOLUTION_CHECKS + """SELECT seq, round(coalesce(coherence, 0.0), 6) AS r_coherence,
  round(coalesce(relevance, 0.0) * 2, 6) AS r_relevance, round(coalesce(structure, 0.0) * 0.5, 6) AS r_structure FROM sol_validated""")
def _(spark, sf):
    return checked_solutions(spark, sf).select(
        "seq", r6(R.reward_linear(F.col("validation.coherence"))).alias("r_coherence"),
        r6(R.reward_linear(F.col("validation.relevance"), 2.0)).alias("r_relevance"),
        r6(R.reward_linear(F.col("validation.structure"), 0.5)).alias("r_structure"))


@query("reward_accuracy", SOLUTION_CHECKS + """SELECT seq,
  round(CASE WHEN is_valid THEN correctness ** 1.5 ELSE 0.0 END, 6) AS reward FROM sol_validated""")
def _(spark, sf):
    return checked_solutions(spark, sf).select("seq", r6(R.reward_accuracy(
        F.col("validation.is_valid"), F.col("validation.correctness"))).alias("reward"))


def wide(df, *keys):
    return [r6(F.col("rewards")[k]).alias(k) for k in keys]


@query("reward_vector", S.ALL_TASKS + """SELECT seq, round(r_clarity, 6) AS clarity, round(r_diversity, 6) AS diversity,
  round(r_clarity + r_diversity, 6) AS total FROM task_rewards WHERE is_valid""")
def _(spark, sf):
    out = score_tasks(B.tasks(spark, sf), keys=["clarity", "diversity", "unknown_key"])
    return out.where("validation.is_valid").select("seq", *wide(out, "clarity", "diversity", "total"))


@query("reward_total", S.ALL_TASKS + """SELECT seq, round(CASE WHEN is_valid THEN r_clarity + r_complexity + r_diversity ELSE 0 END, 6) AS total
  FROM task_rewards""")
def _(spark, sf):
    return score_tasks(B.tasks(spark, sf)).select("seq", r6(R.reward_total(F.col("rewards"))).alias("total"))


@query("score_tasks", S.ALL_TASKS + f"""SELECT {TASK_FIELDS}, CASE WHEN is_valid THEN round(r_clarity, 6) END AS r_clarity,
  CASE WHEN is_valid THEN round(r_complexity, 6) END AS r_complexity, CASE WHEN is_valid THEN round(r_diversity, 6) END AS r_diversity,
  CASE WHEN is_valid THEN round(r_clarity + r_complexity + r_diversity, 6) ELSE 0.0 END AS r_total FROM task_rewards""")
def _(spark, sf):
    out = score_tasks(B.tasks(spark, sf))
    keys = ("clarity", "complexity", "diversity", "total")
    return rounded(out.select("iteration", "seq", "validation.*", *[
        r6(F.col("rewards")[k]).alias(f"r_{k}") for k in keys]), "complexity", "clarity")


SOL_REWARD_NAMES = ("accuracy", "coherence", "relevance", "structure")


@query("score_solutions", S.ALL_SOLUTIONS + f"SELECT iteration, seq, {SOL_FIELDS}, " + ", ".join(
    f"CASE WHEN is_valid THEN round(r_{k}, 6) END AS r_{k}" for k in SOL_REWARD_NAMES)
    + ", CASE WHEN is_valid THEN round(r_accuracy + r_coherence + r_relevance + r_structure, 6) ELSE 0.0 END AS r_total FROM sol_rewards")
def _(spark, sf):
    checked = cut(checked_tasks(spark, sf))
    out = score_solutions(accepted_solutions(spark, sf, checked), checked)
    return rounded(out.select("iteration", "seq", "validation.*", *[
        r6(F.col("rewards")[k]).alias(f"r_{k}") for k in (*SOL_REWARD_NAMES, "total")]), *SCORES)


# --- run metrics -----------------------------------------------------------------------

CHECKED = S.with_(S.TASKS, S.VALIDATED_TASKS, S.ACCEPTED_TASKS)


@query("task_counts", S.with_(S.TASKS, S.VALIDATED_TASKS) + """SELECT count(*) AS generated, count(*) FILTER (is_valid) AS valid,
  round(count(*) FILTER (is_valid) / greatest(1, count(*)), 6) AS rate FROM validated""")
def _(spark, sf):
    return rounded(M.task_counts(validated_tasks(B.tasks(spark, sf), force=False)), "rate")


@query("task_type_counts", TYPED + """SELECT coalesce(CASE WHEN NOT is_placeholder THEN type END, 'unknown') AS type,
  count(*) AS n FROM tasks GROUP BY 1""")
def _(spark, sf):
    return M.task_type_counts(B.tasks(spark, sf).withColumn("type", F.when(~F.col("is_placeholder"), F.col("type"))))


TASK_KEYS = """keyed AS (
  SELECT 'clarity' AS key, r_clarity AS value FROM task_rewards WHERE is_valid
  UNION ALL SELECT 'complexity', r_complexity FROM task_rewards WHERE is_valid
  UNION ALL SELECT 'diversity', r_diversity FROM task_rewards WHERE is_valid
  UNION ALL SELECT 'total', CASE WHEN is_valid THEN r_clarity + r_complexity + r_diversity ELSE 0.0 END FROM task_rewards)"""


@query("avg_rewards_by_key", S.ALL_TASKS[:-1] + ",\n" + TASK_KEYS + " SELECT key, round(avg(value), 6) AS average FROM keyed GROUP BY key")
def _(spark, sf):
    return rounded(M.avg_rewards_by_key(score_tasks(B.tasks(spark, sf))), "average")


@query("iteration_rates", S.with_(S.TASKS, S.VALIDATED_TASKS, """per AS (
    SELECT iteration, count(*) AS attempted, count(*) FILTER (is_valid) AS valid FROM validated GROUP BY iteration)""") + """
  SELECT iteration, attempted, valid, round(valid / attempted, 6) AS rate,
    (SELECT round(avg(valid / attempted), 6) FROM per) AS mean_rate FROM per""")
def _(spark, sf):
    rates = M.iteration_rates(validated_tasks(B.tasks(spark, sf), force=False))
    return rounded(rates.withColumn("mean_rate", M.mean_iteration_rate(rates).scalar()), "rate", "mean_rate")


@query("running_task_metrics", CHECKED + """SELECT iteration, seq, count(*) OVER w AS generated,
  (count(*) FILTER (is_valid) OVER w)::BIGINT AS valid,
  'task_' || lpad((count(*) OVER w)::VARCHAR, 6 , '0') AS record FROM gated
  WINDOW w AS (ORDER BY iteration, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return M.running_task_metrics(cut(checked_tasks(spark, sf)))


SUMMARY = S.with_(S.TASKS, S.VALIDATED_TASKS, S.ACCEPTED_TASKS, S.TASK_REWARDS, S.ACCEPTED_SOLUTIONS,
                  S.VALIDATED_SOLUTIONS, S.GATED_SOLUTIONS, S.SOLUTION_REWARDS, TASK_KEYS, """
sol_keyed AS (
  SELECT 'accuracy' AS key, r_accuracy AS value FROM sol_rewards WHERE is_valid
  UNION ALL SELECT 'coherence', r_coherence FROM sol_rewards WHERE is_valid
  UNION ALL SELECT 'relevance', r_relevance FROM sol_rewards WHERE is_valid
  UNION ALL SELECT 'structure', r_structure FROM sol_rewards WHERE is_valid
  UNION ALL SELECT 'total', CASE WHEN is_valid THEN r_accuracy + r_coherence + r_relevance + r_structure ELSE 0.0 END FROM sol_rewards),
its AS (SELECT iteration, count(*) AS n, count(*) FILTER (is_valid) AS v FROM gated GROUP BY iteration),
sol_its AS (SELECT iteration, count(*) AS n, count(*) FILTER (is_valid) AS v FROM sol_gated GROUP BY iteration),
lines(metric, value) AS (
  SELECT 'iterations', count(*)::DOUBLE FROM its
  UNION ALL SELECT 'tasks_generated', count(*)::DOUBLE FROM gated
  UNION ALL SELECT 'tasks_valid', (count(*) FILTER (is_valid))::DOUBLE FROM gated
  UNION ALL SELECT 'task_valid_rate', count(*) FILTER (is_valid) / greatest(1, count(*)) FROM gated
  UNION ALL SELECT 'solutions_generated', count(*)::DOUBLE FROM sol_gated
  UNION ALL SELECT 'solutions_valid', (count(*) FILTER (is_valid))::DOUBLE FROM sol_gated
  UNION ALL SELECT 'solution_valid_rate', count(*) FILTER (is_valid) / greatest(1, count(*)) FROM sol_gated
  UNION ALL SELECT 'task_types.' || type, count(*)::DOUBLE FROM gated GROUP BY type
  UNION ALL SELECT 'avg_task_rewards.' || key, avg(value) FROM keyed GROUP BY key
  UNION ALL SELECT 'avg_solution_rewards.' || key, avg(value) FROM sol_keyed GROUP BY key
  UNION ALL SELECT 'avg_validation_rates.tasks', avg(v / n) FROM its
  UNION ALL SELECT 'avg_validation_rates.solutions', avg(coalesce(s.v / s.n, 0)) FROM its i LEFT JOIN sol_its s USING (iteration))""")


def summary(spark, sf):
    scored = cut(score_tasks(B.tasks(spark, sf)))
    solved = cut(score_solutions(accepted_solutions(spark, sf, scored), scored))
    return M.run_summary(scored, solved)


@query("run_summary", SUMMARY + "SELECT metric, round(value, 6) AS value FROM lines")
def _(spark, sf):
    return rounded(summary(spark, sf), "value")


# --- drawing types and seeds -----------------------------------------------------------

SEEDS = f"""seeds AS (SELECT item_id, text AS task, {S.draw_type(S.uniform("'seedtype'", "item_id"))} AS type FROM benchmark),
numbered AS (SELECT type, task, row_number() OVER (PARTITION BY type ORDER BY item_id) - 1 AS seed_no,
  count(*) OVER (PARTITION BY type) AS seeds FROM seeds)"""


def seeds(spark, sf):
    kind = G.draw_type(G.uniform(F.lit("seedtype"), F.col("item_id")))
    return B.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("task"), kind.alias("type"))


@query("seed_or_generate", S.with_(S.TASKS, SEEDS, f"""
sizes AS (SELECT type, max(seeds) AS seeds FROM numbered GROUP BY type),
drawn AS (SELECT iteration, seq, {S.draw_type(S.uniform("'type'", "'7'", "iteration", "seq"))} AS type,
  {S.uniform("'seed'", "'7'", "iteration", "seq")} AS u, {S.uniform("'pick'", "'7'", "iteration", "seq")} AS p FROM tasks),
sized AS (SELECT d.*, CASE WHEN s.seeds > 0 AND u < 0.2 THEN floor(p * s.seeds)::BIGINT END AS seed_no
  FROM drawn d LEFT JOIN sizes s USING (type))""") + """
  SELECT iteration, seq, s.type, n.task AS seed_task, s.seed_no IS NOT NULL AS from_seed FROM sized s
  LEFT JOIN numbered n ON n.type = s.type AND n.seed_no = s.seed_no""")
def _(spark, sf):
    draws = B.tasks(spark, sf).select("iteration", "seq")
    return G.seed_or_generate(draws, seeds(spark, sf), "item_id", seed=7).drop("seed_no")


@query("seed_fallback", S.with_(S.TASKS, SEEDS, f"""
sizes AS (SELECT type, max(seeds) AS seeds FROM numbered WHERE type <> 'abduction' GROUP BY type),
drawn AS (SELECT iteration, seq, found, {S.draw_type(S.uniform("'type'", "'7'", "iteration", "seq"))} AS type,
  {S.uniform("'seed'", "'7'", "iteration", "seq")} AS u, {S.uniform("'pick'", "'7'", "iteration", "seq")} AS p FROM tasks),
sized AS (SELECT d.*, CASE WHEN s.seeds > 0 AND (u < 0.2 OR found IS NULL) THEN floor(p * s.seeds)::BIGINT END AS seed_no
  FROM drawn d LEFT JOIN sizes s USING (type))""") + f"""
  SELECT iteration, seq, s.type, s.seed_no IS NOT NULL AS from_seed, s.seed_no IS NULL AND found IS NULL AS is_placeholder,
    coalesce(n.task, {S.short_task('found', 's.type')}, {S.placeholder_task('s.type')}) AS task
  FROM sized s LEFT JOIN numbered n ON n.type = s.type AND n.seed_no = s.seed_no""")
def _(spark, sf):
    """Generations, some of them failed; one type has no seeds, so that its failures end as placeholders."""
    draws = B.tasks(spark, sf).select("iteration", "seq", "found")
    known = seeds(spark, sf).where("type <> 'abduction'")
    return G.seed_or_generate(draws, known, "item_id", seed=7, generated="found").select(
        "iteration", "seq", "type", "from_seed", "is_placeholder", "task")
