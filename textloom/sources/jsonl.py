"""JSON Lines inputs with counted rejects."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.fixed_values import TASK_TYPES
from textloom.functions.text import blank_words, let, strip_blanks


def _enclosed(bare: Column) -> tuple[Column, Column]:
    """The line as the one element of a list and of an object.

    The parsers ignore what follows a complete value. Text behind the line's object would
    have to close or continue both to go unseen, which no text can.
    """
    return F.concat(F.lit("["), bare, F.lit("]")), F.concat(F.lit('{"item":'), bare, F.lit("}"))


def _by_variant(bare: Column, names: Sequence[str]) -> Column:
    """Wanted fields of a line without repeated keys, NaN and Infinity; the others are null."""
    in_list, in_object = _enclosed(bare)
    parsed = F.when(F.try_parse_json(in_list).isNotNull(), F.try_variant_get(F.try_parse_json(in_object), "$.item", "variant"))
    return let(parsed, lambda value: F.when(F.schema_of_variant(value).startswith("OBJECT"), F.struct(*[
        F.try_variant_get(value, f"$.{n}", "variant").alias(n) for n in names])))


def _by_schema(bare: Column, names: Sequence[str]) -> Column:
    """Wanted fields of a line that the first parser refuses.

    Here the last of repeated keys counts, NaN and infinities are numbers, and fields that nobody wants
    are passed over whatever they hold. Each wanted field is parsed by itself, as a string too,
    which tells its last value from an earlier one that could be read; a last value that is an
    object with repeated keys counts as an empty object, as no reader looks into it.
    """
    in_list, in_object = _enclosed(bare)
    corrupt = {"columnNameOfCorruptRecord": "_bad"}
    lone = F.size(F.from_json(in_list, f"array<struct<{names[0]}: string>>")) == 1
    whole = F.from_json(in_object, f"item struct<{names[0]}: string>, _bad string", corrupt)

    def field(name: str) -> Column:
        found = F.from_json(in_object, f"item struct<{name}: variant>, _bad string", corrupt)
        last = F.from_json(in_object, f"item struct<{name}: string>")["item"][name]
        return let(found, lambda row: F.when(
            row["_bad"].isNull() | (F.try_variant_get(row["item"][name], "$", "string") == last), row["item"][name]
        ).otherwise(F.parse_json(F.lit("{}"))))

    valid = let(whole, lambda row: row["item"].isNotNull() & row["_bad"].isNull())
    return F.when(lone & valid, F.struct(*[field(n).alias(n) for n in names]))


def _item(line: Column, names: Sequence[str]) -> Column:
    """Struct of the wanted fields, as VARIANT, of a line that is one JSON object, else null.

    Null in a field means that the object lacks it; a JSON null is a VARIANT null.
    """
    return let(strip_blanks(line), lambda bare: F.coalesce(_by_variant(bare, names), _by_schema(bare, names)))


def _rows(lines: DataFrame, col: str, keep: tuple[str, ...], names: Sequence[str], wanted: Callable[[Column], Column],
          fields: Callable[[Column], list[Column]]) -> DataFrame:
    """Fields of the wanted objects. A generator parses once, where a filter would twice."""
    row = let(_item(F.col(col), names), lambda item: F.when(
        item.isNotNull() & wanted(item), F.array(F.struct(*fields(item)))
    ))
    return lines.select(*keep, F.inline(row))


def has_field(item: Column, name: str) -> Column:
    """True where the object has the field, a JSON null included."""
    return item[name].isNotNull()


def text_field(item: Column, name: str) -> Column:
    return F.try_variant_get(item[name], "$", "string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``value``; splits large files over tasks."""
    return spark.read.text(path)


def scan_text_lines(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """One row per line of a text column, column ``value``, like a line-based reader."""
    lines = F.split(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), "\n")
    exploded = df.select(*keep, F.posexplode_outer(lines).alias("line_no", "value"))
    return exploded.where("value is not null")


def scan_jsonl_pretrain(lines: DataFrame, col: str = "value", *keep: str) -> DataFrame:
    """Rows that parse and have ``text``: text, tokens, ids, image, label.

    ``tokens`` are the blank-separated words of a string. Of a list, ``tokens`` holds the texts
    and ``ids`` the integers, each at its place, with null in the other; other values
    are unknown words. A number or an object has neither; its row stays.
    """
    def fields(item: Column) -> list[Column]:
        value = item["text"]
        text = F.when(F.schema_of_variant(value) == "STRING", text_field(item, "text"))
        listed = F.try_variant_get(value, "$", "array<variant>")

        def whole(e: Column) -> Column:
            return F.when(F.schema_of_variant(e) == "BIGINT", F.try_variant_get(e, "$", "int"))

        words = F.transform(listed, lambda e: F.when(F.schema_of_variant(e) != "BIGINT", F.try_variant_get(e, "$", "string")))
        return [
            text.alias("text"), F.coalesce(blank_words(text), words).alias("tokens"),
            F.transform(listed, whole).alias("ids"),
            text_field(item, "image").alias("image"), text_field(item, "label").alias("label"),
        ]

    return _rows(lines, col, keep, ("text", "image", "label"), lambda item: has_field(item, "text"), fields)


def scan_jsonl_sft(lines: DataFrame, col: str = "value", *keep: str) -> DataFrame:
    """Rows that parse and have both ``instruction`` and ``output``."""
    return _rows(
        lines, col, keep, ("instruction", "output"), lambda item: has_field(item, "instruction") & has_field(item, "output"),
        lambda item: [text_field(item, n).alias(n) for n in ("instruction", "output")],
    )


def scan_seed_tasks(lines: DataFrame, col: str = "value", *keep: str,
                    types: list[str] = TASK_TYPES) -> DataFrame:
    """(type, task) of the lines that parse and name a known type.

    Rows stay rows: three types would otherwise be three cells holding the whole table.
    """
    return _rows(
        lines, col, keep, ("type", "task"),
        lambda item: text_field(item, "type").isin(types) & has_field(item, "task"),
        lambda item: [text_field(item, n).alias(n) for n in ("type", "task")],
    )


def line_rejects(lines: DataFrame, required: list[str], col: str = "value") -> DataFrame:
    """One row: lines read, lines that are no JSON object, objects without a required field."""
    def verdict(item: Column) -> Column:
        whole = F.lit(True)
        for name in required:
            whole = whole & has_field(item, name)
        return F.when(item.isNull(), "bad_json").when(~whole, "missing_field").otherwise("read")

    verdicts = lines.select(let(_item(F.col(col), required), verdict).alias("verdict"))
    return verdicts.agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("verdict") == "bad_json").alias("bad_json"),
        F.count_if(F.col("verdict") == "missing_field").alias("missing_field"),
    )
