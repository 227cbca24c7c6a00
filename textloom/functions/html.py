"""Visible text of HTML pages.

Almost all pages are handled by native regular expressions. Pages on which those
could differ from a real parser (nested or unclosed boilerplate elements, rare
entities, stray markup) are recognised and go through a tolerant parser in an
Arrow UDF; for all other rows the UDF receives null.
"""
from __future__ import annotations

from collections import Counter
from functools import reduce
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.fixed_values import NON_CONTENT_TAGS
from textloom.functions.text import let, strip_blanks, with_once

MARK = "\x01"  # separates text nodes; newlines inside a node must survive
# Elements without visible text: those to be dropped, and those no page shows.
_DROPPED = (*NON_CONTENT_TAGS, "template", "rt", "rp")
BLOCKS = r"(?is)<(?:!--.*?-->" + "".join(
    rf"|{tag}(?:\s[^>]*)?>.*?</{tag}\s*>" for tag in _DROPPED
) + ")"
TAGS = r"""(?s)<(?:/?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|!(?i:doctype)[^>]*>)"""
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'",
    "&nbsp;": "\xa0", "&copy;": "\xa9", "&middot;": "\xb7", "&amp;": "&",
}
_OTHER_ENTITY = "&(?!" + "|".join(e[1:] for e in ENTITIES) + ")[A-Za-z#]"
# A reference as the parser delimits it: names take in dots and hyphens, numbers end before any hex digit.
_REFERENCE = r"&(?:#(?:[0-9]++(?![a-fA-F])|[xX][0-9a-fA-F]++);?|[a-zA-Z][-.a-zA-Z0-9]*+;?)"
# References at the very end of a page are cut off for the parser.
_LAST_REFERENCE = r"&#?[-.a-zA-Z0-9]*\z"
_NAMES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
# Numbers that stand for another character, or for none.
_NUMBERS = {n: unescape(f"&#{n};") for n in [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | e for p in range(17) for e in (0xFFFE, 0xFFFF))]}
_NUMBERS = {n: char for n, char in _NUMBERS.items() if char != chr(n)}
_SPECIAL = r"(?i)<(textarea|plaintext|xmp|iframe|noembed|noframes)\b|\x01"
_HALF_BLOCK = r"(?i)</?(" + "|".join(_DROPPED) + r")[\s/>]"
_OPAQUE = r"(?is)<(?:!--.*?-->|script(?:\s[^>]*)?>.*?</script\s*>|style(?:\s[^>]*)?>.*?</style\s*>)"
_CONTAINERS = "html body main article section div span table tr td ul ol li form p a".split()
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input "
    "isindex keygen link menuitem meta nextid param source spacer track wbr".split()
)
_SILENT = frozenset(_DROPPED)


class _TextNodes(HTMLParser):
    """Collects text nodes outside the dropped elements."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes, self.buffer = [], []
        self.open, self.counts = [], Counter()

    def flush(self):
        node = "".join(self.buffer).strip()
        self.buffer = []
        if node and not any(self.counts[tag] for tag in _SILENT):
            self.nodes.append(node)

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_charref(self, name):
        self.buffer.append(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.buffer.append(html5.get(f"{name};", f"&{name}"))

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag not in _VOID:
            self.open.append(tag)
            self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        while self.counts[tag]:
            top = self.open.pop()
            self.counts[top] -= 1
            if top == tag:
                break

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def parse_visible_text(html: str) -> str:
    """Text of one page by the tolerant parser; '' when it cannot be parsed."""
    parser = _TextNodes()
    try:
        parser.feed(html)
        parser.close()
    except Exception:  # a page the parser refuses has no text
        return ""
    parser.flush()
    return "\n".join(parser.nodes)


def _parse_batch(html: pd.Series) -> pd.Series:
    return html.map(parse_visible_text, na_action="ignore")


def without_blocks(html: Column) -> Column:
    """The page with comments and dropped elements replaced by one mark each."""
    return F.regexp_replace(html, BLOCKS, MARK)


def _closes_outside(block: Column) -> Column:
    """True where a dropped element closes an element opened before it, which ends both."""
    bare = F.regexp_replace(block, _OPAQUE, "")
    return let(bare, lambda b: reduce(lambda x, y: x | y, [
        F.regexp_count(b, F.lit(rf"(?i)</{tag}\s*>")) > F.regexp_count(b, F.lit(rf"(?i)<{tag}[\s/>]"))
        for tag in _CONTAINERS
    ]))


def needs_parser(html: Column, blocked: Column, marked: Column) -> Column:
    """True where the native expressions could differ from a parser."""
    blocks = F.filter(
        F.regexp_extract_all(html, F.lit(BLOCKS), F.lit(0)), lambda b: ~b.rlike("(?i)^<(!--|script|style)")
    )
    return (
        marked.rlike(r"<[A-Za-z/!?]") | blocked.rlike(_HALF_BLOCK) | html.rlike(_LAST_REFERENCE)
        | html.rlike(_SPECIAL) | F.exists(blocks, _closes_outside)
    )


def _character(reference: Column) -> Column:
    """The text of one reference; an unknown name keeps its ampersand and loses its semicolon."""
    names, chars = (F.lit(list(values)) for values in (_NAMES.keys(), _NAMES.values()))
    numbers, others = (F.lit(list(values)) for values in (_NUMBERS.keys(), _NUMBERS.values()))

    def named(name: Column) -> Column:
        return let(F.array_position(names, name), lambda at: F.when(at > 0, F.get(chars, (at - 1).cast("int"))).otherwise(
            F.concat(F.lit("&"), name)))

    def numbered(digits: Column) -> Column:
        hexadecimal = digits.rlike("^[xX]")
        bare = F.regexp_replace(digits, "^[xX]?0*", "")
        code = F.when(F.length(bare) > 8, F.lit(1 << 40)).otherwise(F.coalesce(F.when(
            hexadecimal, F.conv(bare, 16, 10)).otherwise(bare).try_cast("bigint"), F.lit(0).cast("bigint")))

        def char(n: Column) -> Column:
            other = F.array_position(numbers, n.cast("int"))
            valid = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            made = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
            return F.when(~valid, F.lit("\ufffd")).when(other > 0, F.get(others, (other - 1).cast("int"))).otherwise(made)

        return let(code, char)

    body = F.regexp_replace(reference, "^&#?|;$", "")
    return F.when(reference.startswith("&#"), numbered(body)).otherwise(named(body))


def decoded(text: Column) -> Column:
    """``text`` with its character references replaced; only rare ones need to be looked up."""
    def common(t: Column) -> Column:
        for entity, char in ENTITIES.items():
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    def every(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)), _character)
        return let(found, lambda chars: F.array_join(F.transform(
            F.split(t, _REFERENCE, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(chars, i), F.lit("")))), ""))

    return let(text, lambda t: F.when(t.rlike(_OTHER_ENTITY), every(t)).otherwise(common(t)))


def marked_text(marked_html: Column) -> Column:
    """Text nodes of a marked page: entities decoded, stripped, joined by newlines."""
    text = decoded(marked_html)
    nodes = F.transform(F.split(text, MARK), strip_blanks)
    return F.array_join(F.array_remove(nodes, ""), "\n")


def html_to_text(df: DataFrame, html_col: str, out_col: str = "text",
                 engine: str = "auto") -> DataFrame:
    """Add the visible text, one text node per line; ``engine`` is auto, native or parser."""
    html = F.col(html_col)
    parse = F.pandas_udf(_parse_batch, "string")
    if engine == "parser":
        return with_once(df, **{out_col: parse(html)})
    staged = df.withColumn("_blocked", without_blocks(html)).withColumn(
        "_marked", F.regexp_replace("_blocked", TAGS, MARK)
    )
    text = marked_text(F.col("_marked"))
    if engine == "auto":
        hard = needs_parser(html, F.col("_blocked"), F.col("_marked"))
        staged = staged.withColumn("_hard", hard)
        parsed = parse(F.when(F.col("_hard"), html))
        text = F.when(F.col("_hard"), parsed).otherwise(text)
    elif engine != "native":
        raise ValueError(f"unknown engine {engine!r}: use auto, native or parser")
    return with_once(staged, **{out_col: text}).drop("_blocked", "_marked", "_hard")


def decode_body(body: Column) -> Column:
    """Page bytes as text; bytes that are not UTF-8 become U+FFFD."""
    return F.make_valid_utf8(body.cast("string"))
