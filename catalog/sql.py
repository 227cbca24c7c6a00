"""Pieces of the DuckDB check queries."""
from __future__ import annotations

from textloom.functions.fixed_values import (
    ASCII_PUNCTUATION, BLANK, BLANK_CHARS, COMPARISON_OPERATORS, CONCLUSION_OPENINGS, LOGIC_WORDS,
    MATH_OPERATORS, PLACEHOLDER_SOLUTION_DEFAULT, PLACEHOLDER_SOLUTIONS, PLACEHOLDER_TASK,
    SHORT_TASK, STOP_WORDS, TASK_PREFIXES, TRANSITIONS,
)


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lits(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {lit(BLANK_CHARS)})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda w: w <> '')"


def jaccard(a: str, b: str) -> str:
    return (f"(len(list_intersect({a}, {b}))::DOUBLE"
            f" / nullif(len(list_distinct(list_concat({a}, {b}))), 0))")


def count_all(x: str, needles) -> str:
    return "(" + " + ".join(
        f"((length({x}) - length(replace({x}, {lit(n)}, ''))) // {len(n)})" for n in needles
    ) + ")"


def code_blocks(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({x}, '(?s)```(?:python)?(.*?)```', 1),"
            f" lambda b: {strip('b')}), lambda b: b <> '')")


def uniform(*keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0)"


def draw_type(u: str) -> str:
    return f"CASE WHEN {u} < 0.3 THEN 'abduction' WHEN {u} < 0.6 THEN 'deduction' ELSE 'induction' END"


def fill(template: str, **values: str) -> str:
    out = lit(template)
    for name, expr in values.items():
        out = f"replace({out}, '{{{name}}}', {expr})"
    return out


def placeholder_task(kind: str) -> str:
    return fill(PLACEHOLDER_TASK, type=kind)


def placeholder_solution(task: str, kind: str) -> str:
    cases = " ".join(
        f"WHEN '{t}' THEN {fill(text, head=f'substr({task}, 1, 60)')}"
        for t, text in PLACEHOLDER_SOLUTIONS.items()
    )
    return f"CASE {kind} {cases} ELSE {lit(PLACEHOLDER_SOLUTION_DEFAULT)} END"


def short_task(task: str, kind: str) -> str:
    return (f"CASE WHEN length({task}) < 15 THEN {fill(SHORT_TASK, type=kind, task=task)}"
            f" ELSE {task} END")


def extract_answer(x: str) -> str:
    pattern = "'(?s)<answer>(.*?)</answer>'"
    return (f"CASE WHEN {strip(x)} = '' THEN NULL WHEN regexp_matches({x}, {pattern})"
            f" THEN nullif({strip(f'regexp_extract({x}, {pattern}, 1)')}, '') ELSE {strip(x)} END")


# Turns of `conversations` stand in for generations: the digest of a turn decides how its
# text is dressed, so that every branch of the readers occurs.
RAW_TASK = """CASE substr(h, 1, 1)
 WHEN '0' THEN 'Task: ' || text
 WHEN '1' THEN 'Problem:' || text
 WHEN '2' THEN 'Short' || chr(10) || text || chr(10) || 'third' || chr(10) || 'fourth'
 WHEN '3' THEN text || chr(10) || '```python' || chr(10) || 'print(1 + 2)' || chr(10) || '```'
 WHEN '4' THEN text || ' If x >= 3 and y <= 10.5 then is 2 + 3 * 4 == 14, or not?'
 WHEN '5' THEN '  ' || chr(10)
 WHEN '6' THEN 'Question: Why?'
 ELSE text END"""
RAW_SOLUTION = """CASE substr(h, 1, 1)
 WHEN '0' THEN 'Steps.' || chr(10) || '<answer> ' || text || '</answer>' || chr(10) || '<answer>no</answer>'
 WHEN '1' THEN '1. ' || replace(text, '. ', '.' || chr(10) || '2) ')
 WHEN '2' THEN text || chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || 'Therefore, x.'
 WHEN '3' THEN ' '
 WHEN '4' THEN '- First, because ' || text || chr(10) || chr(10) || 'Conclusion: thus it holds.'
 WHEN '5' THEN 'Too short'
 ELSE text END"""

_TASK_TEXT = strip("raw")
_NO_PREFIX = "lines[1]"
for _p in TASK_PREFIXES:
    _NO_PREFIX = (f"(CASE WHEN starts_with({_NO_PREFIX}, '{_p}')"
                  f" THEN {strip(f'substr({_NO_PREFIX}, 1 + {len(_p)})')} ELSE {_NO_PREFIX} END)")

TASKS = f"""turns AS (
  SELECT conv_id, turn, text, md5('t:' || conv_id || ':' || turn) AS h
  FROM conversations WHERE role = 'user'),
generated AS (
  SELECT conv_id, turn, conv_id // 5 + 1 AS iteration, conv_id * 1000000 + turn AS seq, h,
    {RAW_TASK} AS raw FROM turns),
typed AS (
  SELECT *, {draw_type(uniform("'type'", "'0'", "iteration", "seq"))} AS type,
    string_split({_TASK_TEXT}, chr(10)) AS lines FROM generated),
first_lines AS (SELECT *, {_NO_PREFIX} AS first_line FROM typed),
extracted AS (
  SELECT * EXCLUDE (first_line), nullif(CASE WHEN length(first_line) < 15 AND len(lines) > 1
    THEN array_to_string(lines[1:3], ' ') ELSE first_line END, '') AS found FROM first_lines),
tasks AS (
  SELECT conv_id, turn, iteration, seq, type, raw, found,
    coalesce({short_task('found', 'type')}, {placeholder_task('type')}) AS task,
    substr(h, 2, 1) = 'a' AS from_seed, found IS NULL AS is_placeholder FROM extracted)"""

def solutions_of(source: str) -> str:
    """CTEs giving solutions of the tasks in a source."""
    return f"""answers AS (
  SELECT conv_id, turn - 1 AS turn, text, md5('s:' || conv_id || ':' || (turn - 1)) AS h
  FROM conversations WHERE role = 'assistant'),
raw_solutions AS (SELECT conv_id, turn, {RAW_SOLUTION} AS raw_generation FROM answers),
solutions AS (
  SELECT t.conv_id, t.turn, t.iteration, t.seq, t.type, t.task,
    coalesce({extract_answer('raw_generation')}, {placeholder_solution('t.task', 't.type')}) AS solution,
    CASE WHEN {extract_answer('raw_generation')} IS NULL THEN '' ELSE raw_generation END AS raw_generation,
    {extract_answer('raw_generation')} IS NULL AS is_placeholder
  FROM raw_solutions s JOIN {source} t USING (conv_id, turn))"""


SOLUTIONS = solutions_of("tasks")


def complexity(x: str) -> str:
    w = f"({words(f'lower({x})')})"
    n = f"len({w})"
    return f"""CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.1::DOUBLE,
      least(1.0::DOUBLE, {n} / 150.0::DOUBLE) * 0.15::DOUBLE
      + least(1.0::DOUBLE, len(list_distinct({w}))::DOUBLE / {n} * 1.5::DOUBLE) * 0.20::DOUBLE
      + least(1.0::DOUBLE, len(list_filter({w}, lambda v: length(v) > 8)) / 10.0::DOUBLE) * 0.15::DOUBLE
      + least(1.0::DOUBLE, len(regexp_extract_all({x}, '\\b\\d+\\.?\\d*\\b')) / 8.0::DOUBLE) * 0.15::DOUBLE
      + least(1.0::DOUBLE, (len(list_filter({w}, lambda v: list_contains({lits(LOGIC_WORDS)}, v)))
          + {count_all(x, COMPARISON_OPERATORS)}) / 10.0::DOUBLE) * 0.20::DOUBLE
      + least(1.0::DOUBLE, {count_all(x, MATH_OPERATORS)} / 8.0::DOUBLE) * 0.10::DOUBLE
      + least(1.0::DOUBLE, len({code_blocks(x)}) * 0.5::DOUBLE) * 0.05::DOUBLE) END"""


def syllables(w: str) -> str:
    return (f"greatest(1, len(regexp_extract_all(lower({w}), '[aeiouy]+'))"
            f" - (CASE WHEN ends_with(lower({w}), 'e') THEN 1 ELSE 0 END)"
            f" + (CASE WHEN regexp_matches(lower({w}), '(?s)[^aeiouy]le\\z') THEN 1 ELSE 0 END))")


def clarity(x: str) -> str:
    sentences = (f"len(list_filter(regexp_split_to_array({x}, '[.!?]+'),"
                 f" lambda s: length({strip('s')}) > 3))")
    bare = (f"list_filter(list_transform({words(x)}, lambda w: trim(w, {lit(ASCII_PUNCTUATION)})),"
            f" lambda w: w <> '')")
    n = f"len({bare})"
    syll = f"list_sum(list_transform({bare}, lambda w: {syllables('w')}))"
    return f"""CASE WHEN {n} < 5 OR {sentences} < 1 THEN 0.0::DOUBLE ELSE
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, (206.835::DOUBLE - 1.015::DOUBLE * ({n}::DOUBLE / {sentences})
        - 84.6::DOUBLE * ({syll}::DOUBLE / {n})) / 100.0::DOUBLE)) * 0.85::DOUBLE
      + (CASE WHEN contains({x}, '?') THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) * 0.15::DOUBLE END"""


def content(x: str) -> str:
    return (f"list_distinct(list_filter({words(f'lower({x})')},"
            f" lambda v: NOT list_contains({lits(STOP_WORDS)}, v)))")


def coherence(table: str, key: str, x: str) -> str:
    """SELECT of (key, coherence) for a table; neighbours are joined, not folded."""
    return f"""SELECT b.{key}, CASE WHEN coalesce(len(b.s), 0) <= 1 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE
        + least(1.0::DOUBLE, {count_all(f'lower(b.x)', TRANSITIONS)} / (len(b.s) * 0.25::DOUBLE)) * 0.4::DOUBLE
        + coalesce(p.overlap, 0.0) * 0.6::DOUBLE END AS coherence
      FROM (SELECT {key}, {x} AS x, list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'),
              lambda s: {strip('s')}), lambda s: len({words('s')}) > 3) AS s FROM {table}) b
      LEFT JOIN (
        SELECT {key}, avg({jaccard('a', 'c')}) AS overlap FROM (
          SELECT {key}, no, w AS c, lag(w) OVER (PARTITION BY {key} ORDER BY no) AS a FROM (
            SELECT {key}, no, {content('sentence')} AS w FROM (
              SELECT {key}, unnest(s) AS sentence, generate_subscripts(s, 1) AS no FROM (
                SELECT {key}, list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'),
                  lambda s: {strip('s')}), lambda s: len({words('s')}) > 3) AS s FROM {table}))))
        WHERE len(a) > 0 AND len(c) > 0 GROUP BY {key}) p ON p.{key} = b.{key}"""


def relevance(task: str, solution: str) -> str:
    return (f"CASE WHEN len({content(task)}) = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE,"
            f" 0.2::DOUBLE + coalesce({jaccard(content(task), content(solution))}, 0.0) * 2.0::DOUBLE) END")


def structure(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    filled = f"list_filter({lines}, lambda s: {strip('s')} <> '')"
    numbered = f"len(list_filter({filled}, lambda s: regexp_matches(s, '^{BLANK}*\\d+[.)]')))"
    bullets = f"len(list_filter({filled}, lambda s: regexp_matches(s, '^{BLANK}*[-*•]')))"
    closing = f"len(list_filter({filled}, lambda s: " + " OR ".join(
        f"starts_with({strip('lower(s)')}, '{o}')" for o in CONCLUSION_OPENINGS) + "))"
    return f"""CASE WHEN len({lines}) <= 1 THEN 0.2::DOUBLE ELSE 0.2::DOUBLE + least(1.0::DOUBLE,
      coalesce(({numbered} + {bullets} + {closing} * 2) / nullif(len({filled}) * 0.5::DOUBLE, 0), 0.0)) * 0.8::DOUBLE END"""


VALIDATED_TASKS = f"""scored AS MATERIALIZED (SELECT *, {complexity('task')} AS cx, {clarity('task')} AS cl FROM tasks),
validated AS MATERIALIZED (
  SELECT *, CASE WHEN is_placeholder THEN true WHEN length(task) < 15 OR length(task) > 2500 THEN false
      ELSE (cx >= 0.2 AND cl >= 0.4) OR from_seed END AS is_valid,
    CASE WHEN is_placeholder THEN 0.5 WHEN length(task) < 15 OR length(task) > 2500 THEN NULL ELSE cx END AS complexity,
    CASE WHEN is_placeholder THEN 0.5 WHEN length(task) < 15 OR length(task) > 2500 THEN NULL ELSE cl END AS clarity,
    CASE WHEN is_placeholder THEN 'Placeholder task accepted' WHEN length(task) < 15 THEN 'Task too short'
      WHEN length(task) > 2500 THEN 'Task too long'
      WHEN NOT ((cx >= 0.2 AND cl >= 0.4) OR from_seed) THEN 'Failed metric thresholds' END AS reason
  FROM scored)"""
ACCEPTED_TASKS = """gated AS (
  SELECT * REPLACE (is_valid OR iteration <= 10 AS is_valid,
    CASE WHEN NOT is_valid AND iteration <= 10 THEN 'Forced accept' ELSE reason END AS reason)
  FROM validated)"""


def gram_set(x: str, n: int) -> str:
    w = words(f"lower({x})")
    if n == 1:
        return f"list_distinct({w})"
    return (f"list_distinct(list_transform(range(1, greatest(1, len({w}) - {n - 2})),"
            f" lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), ' ')))")


def likeness(a: str, b: str) -> str:
    return " + ".join(
        f"{weight}::DOUBLE * coalesce({jaccard(f'{a}.g{n}', f'{b}.g{n}')}, 1.0::DOUBLE)"
        for n, weight in ((1, 0.2), (2, 0.4), (3, 0.4))
    )


def closest(source: str) -> str:
    """CTEs giving closest(iteration, seq, max_similarity, closest_seq) of the rows of source."""
    return f"""grams AS MATERIALIZED (SELECT iteration, seq, {', '.join(f"{gram_set('task', n)} AS g{n}" for n in (1, 2, 3))}
  FROM {source}),
pairs AS (SELECT c.iteration, c.seq, p.seq AS prev, {likeness('c', 'p')} AS sim
  FROM grams c JOIN grams p ON p.iteration = c.iteration AND p.seq < c.seq),
best AS (SELECT iteration, seq, max(sim) AS max_similarity FROM pairs GROUP BY ALL),
closest AS (SELECT g.iteration, g.seq, b.max_similarity,
    (SELECT min(p.prev) FROM pairs p WHERE p.iteration = g.iteration AND p.seq = g.seq
      AND p.sim = b.max_similarity) AS closest_seq
  FROM grams g LEFT JOIN best b USING (iteration, seq))"""


TASK_REWARDS = f"""{closest("(SELECT * FROM gated WHERE is_valid)")},
task_rewards AS (SELECT g.*, coalesce(clarity, 0.0) AS r_clarity,
    exp(-((coalesce(complexity, 0.0) - 0.7) ** 2) / (2 * 0.15 ** 2)) AS r_complexity,
    1.0 - coalesce(max_similarity, 0.0) AS r_diversity
  FROM gated g LEFT JOIN closest USING (iteration, seq))"""

VALIDATED_SOLUTIONS = f"""coherent AS MATERIALIZED ({coherence('solutions', 'seq', 'solution')}),
sol_scored AS MATERIALIZED (
  SELECT s.*, c.coherence AS co, {relevance('s.task', 's.solution')} AS re, {structure('s.raw_generation')} AS st,
    len({words('s.solution')}) AS n FROM solutions s JOIN coherent c USING (seq)),
sol_validated AS MATERIALIZED (
  SELECT * EXCLUDE (co, re, st, n),
    CASE WHEN is_placeholder THEN true WHEN n < 10 THEN false
      ELSE (co >= 0.4 AND re >= 0.4 AND st >= 0.3 AND (co + re + st) / 3 >= 0.45) OR n >= 50 END AS is_valid,
    CASE WHEN is_placeholder THEN 0.5 WHEN n < 10 THEN 0.0 ELSE (co + re + st) / 3 END AS correctness,
    CASE WHEN is_placeholder THEN 0.5 WHEN n < 10 THEN NULL ELSE co END AS coherence,
    CASE WHEN is_placeholder THEN 0.5 WHEN n < 10 THEN NULL ELSE re END AS relevance,
    CASE WHEN is_placeholder THEN 0.5 WHEN n < 10 THEN NULL ELSE st END AS structure,
    CASE WHEN is_placeholder THEN 'Placeholder solution accepted' WHEN n < 10 THEN 'Solution too short'
      WHEN NOT ((co >= 0.4 AND re >= 0.4 AND st >= 0.3 AND (co + re + st) / 3 >= 0.45) OR n >= 50)
      THEN 'Failed heuristic metric thresholds' END AS reason
  FROM sol_scored)"""
GATED_SOLUTIONS = """per_iteration AS (
  SELECT iteration, count(*) FILTER (is_valid) AS valid_here FROM gated GROUP BY iteration),
before AS (SELECT iteration, coalesce(sum(valid_here) OVER (ORDER BY iteration
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS valid_before FROM per_iteration),
sol_gated AS (
  SELECT s.* REPLACE (is_valid OR valid_before <= 20 AS is_valid,
    CASE WHEN NOT is_valid AND valid_before <= 20 THEN 'Forced accept' ELSE reason END AS reason)
  FROM sol_validated s JOIN before USING (iteration))"""
SOLUTION_REWARDS = """sol_rewards AS (SELECT *,
    CASE WHEN is_valid THEN coalesce(correctness, 0.0) ** 1.5 ELSE 0.0 END AS r_accuracy,
    coalesce(coherence, 0.0) AS r_coherence, coalesce(relevance, 0.0) AS r_relevance,
    coalesce(structure, 0.0) AS r_structure FROM sol_gated)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ALL_TASKS = with_(TASKS, VALIDATED_TASKS, ACCEPTED_TASKS, TASK_REWARDS)
ACCEPTED_SOLUTIONS = solutions_of("(SELECT * FROM gated WHERE is_valid)")
ALL_SOLUTIONS = with_(TASKS, VALIDATED_TASKS, ACCEPTED_TASKS, ACCEPTED_SOLUTIONS,
                      VALIDATED_SOLUTIONS, GATED_SOLUTIONS, SOLUTION_REWARDS)
