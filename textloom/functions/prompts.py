"""Prompt texts and what is read back from generations."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.fixed_values import (
    BLANK_CHARS, PLACEHOLDER_SOLUTION_DEFAULT, PLACEHOLDER_SOLUTIONS, PLACEHOLDER_TASK,
    SFT_TEMPLATE, SHORT_TASK, SOLUTION_PROMPT, TASK_PREFIXES, TASK_PROMPT, TASK_PROMPT_SUFFIX,
)
from textloom.functions.text import let, strip_blanks

SHORT = 15


def fill(template: str, **values: Column) -> Column:
    """Template with its ``{name}`` marks replaced; values are not scanned again."""
    parts, rest = [], template
    while True:
        hits = [(rest.find("{%s}" % name), name) for name in values if "{%s}" % name in rest]
        if not hits:
            break
        at, name = min(hits)
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts, F.lit(rest))


def by_type(task_type: Column, texts: dict[str, Column], default: Column) -> Column:
    """The column listed for the row's type."""
    chosen = F
    for name, column in texts.items():
        chosen = chosen.when(task_type == name, column)
    return chosen.otherwise(default)


def task_prompt(task_type: Column, base: str = TASK_PROMPT) -> Column:
    suffix = by_type(task_type, {t: F.lit(s) for t, s in TASK_PROMPT_SUFFIX.items()}, F.lit(""))
    return F.concat(F.lit(base), suffix)


def solution_prompt(task: Column, task_type: Column, base: str = SOLUTION_PROMPT,
                    type_hint: bool = True) -> Column:
    hint = F.concat(F.lit(" This is a "), F.coalesce(task_type, F.lit("")), F.lit(" reasoning problem."))
    return F.concat(
        F.lit(base), hint if type_hint else F.lit(""),
        F.lit("\n\n### Problem ###\n"), task, F.lit("\n\n### Solution ###"),
    )


def sft_prompt(instruction: Column, template: str = SFT_TEMPLATE) -> Column:
    """Prompt part of a fine-tuning example: the template without output, right-trimmed."""
    return F.rtrim(_filled(template, instruction, F.lit("")), F.lit(BLANK_CHARS))


def sft_text(instruction: Column, output: Column, template: str = SFT_TEMPLATE) -> Column:
    """Whole text of a fine-tuning example."""
    return _filled(template, instruction, output)


def _filled(template: str, instruction: Column, output: Column) -> Column:
    usable = "{instruction}" in template and "{output}" in template
    return fill(template if usable else SFT_TEMPLATE, instruction=instruction, output=output)


def extract_task(text: Column) -> Column:
    """First line without its prefix; short first lines take up to three lines; or null."""

    def without(prefix: str, task: Column) -> Column:
        return let(task, lambda t: F.when(
            F.startswith(t, F.lit(prefix)),
            strip_blanks(F.substring(t, F.lit(len(prefix) + 1), F.length(t))),
        ).otherwise(t))

    def read(lines: Column) -> Column:
        first = F.get(lines, F.lit(0))
        for prefix in TASK_PREFIXES:
            first = without(prefix, first)
        joined = F.array_join(F.slice(lines, 1, 3), " ")
        return let(first, lambda t: F.when(
            (F.length(t) < SHORT) & (F.size(lines) > 1), joined
        ).otherwise(t))

    return let(let(F.split(strip_blanks(text), "\n"), read), lambda t: F.when(t != "", t))


def expand_short_task(task: Column, task_type: Column) -> Column:
    return let(task, lambda t: F.when(
        F.length(t) < SHORT, fill(SHORT_TASK, type=task_type, task=t)
    ).otherwise(t))


def extract_answer(text: Column) -> Column:
    """Trimmed content of the first answer element, else the trimmed text; blank is null."""
    pattern = r"(?s)<answer>(.*?)</answer>"
    answer = F.when(
        text.rlike(pattern), strip_blanks(F.regexp_extract(text, pattern, 1))
    ).otherwise(strip_blanks(text))
    return let(answer, lambda a: F.when(a != "", a))


def extract_code_blocks(text: Column) -> Column:
    """Trimmed, non-empty bodies of fenced code blocks."""
    bodies = F.regexp_extract_all(text, F.lit("(?s)```(?:python)?(.*?)```"), F.lit(1))
    return F.array_remove(F.transform(bodies, strip_blanks), "")


def placeholder_task(task_type: Column) -> Column:
    return fill(PLACEHOLDER_TASK, type=task_type)


def placeholder_solution(task: Column, task_type: Column) -> Column:
    head = F.substring(task, 1, 60)
    filled = {t: fill(text, head=head) for t, text in PLACEHOLDER_SOLUTIONS.items()}
    return by_type(task_type, filled, F.lit(PLACEHOLDER_SOLUTION_DEFAULT))


def chat_line(role: Column, text: Column) -> Column:
    """``Role: content`` with the role capitalised."""
    head = F.upper(F.substring(role, 1, 1))
    tail = F.lower(F.substring(role, F.lit(2), F.length(role)))
    return F.concat(head, tail, F.lit(": "), text)
