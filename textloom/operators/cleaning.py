"""From web records to clean documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.html import html_to_text
from textloom.operators.spread import spread
from textloom.operators.langid import filter_language, lang_identify

MIN_LENGTH, MAX_LENGTH = 256, 100_000


def is_response(rec_type: Column, status: Column, body: Column) -> Column:
    """Successful response with a non-empty body; cheap, so it runs before HTML work."""
    return (
        (rec_type == "response") & status.isNotNull() & (status == "200") & (F.length(body) > 0)
    )


def filter_response(df: DataFrame, rec_type: str = "rec_type", status: str = "http_status",
                    body: str = "body") -> DataFrame:
    return df.where(is_response(F.col(rec_type), F.col(status), F.col(body)))


def filter_length(df: DataFrame, text_col: str = "text", low: int = MIN_LENGTH,
                  high: int = MAX_LENGTH) -> DataFrame:
    """Texts of low..high characters, both ends included."""
    return df.where(F.length(text_col).between(low, high))


def clean_documents(
    records: DataFrame,
    id_col: str,
    body_col: str = "body",
    model: DataFrame | None = None,
    whitelist: list[str] | None = None,
    low: int = MIN_LENGTH,
    high: int = MAX_LENGTH,
    engine: str = "auto",
) -> DataFrame:
    """(id, text): response filter, HTML to text, length and language filters.

    The length filter runs before the language step, which drops the same rows in any
    order but is the dearer one. Without a model or whitelist every language is kept.
    """
    answered = filter_response(records, body=body_col).select(id_col, body_col)
    pages = html_to_text(spread(answered, id_col), body_col, "text", engine).select(id_col, "text")
    texts = filter_length(pages, "text", low, high)
    if not whitelist:
        return texts
    if model is None:
        raise ValueError("a language whitelist needs a language model")
    named = lang_identify(texts, model, id_col, "text")
    return filter_language(named, F.col("predicted"), whitelist).select(id_col, "text")
