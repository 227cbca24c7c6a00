from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions.text import (
    blank_words, count_substring, jaccard, normalize_text, shingle_words, strip_blanks, word_ngrams,
)


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_normalize_keeps_ascii_by_default(spark):
    assert column(spark, ["für, niño_1!"], normalize_text) == ["fr nio_1"]
    assert column(spark, ["für, niño_1!"], lambda t: normalize_text(t, unicode=True)) == ["für niño_1"]


def test_shingles_of_edge_texts(spark):
    got = column(spark, ["", " a b ", "A a  a", "?!", None], shingle_words)
    assert got == [[""], ["", "a", "b"], ["a"], [""], None]


def test_ngrams(spark):
    got = column(spark, ["a b c a b", "a", ""], lambda t: word_ngrams(blank_words(t), 2))
    assert got == [["a b", "b c", "c a"], [], []]


def test_count_substring_does_not_overlap(spark):
    assert column(spark, ["aaaa a"], lambda t: count_substring(t, "aa")) == [2]


def test_jaccard_of_empty_sets_is_null(spark):
    empty = F.array().cast("array<string>")
    row = spark.range(1).select(
        jaccard(empty, empty).alias("both"), jaccard(F.array(F.lit("a")), empty).alias("one")
    ).first()
    assert row.both is None and row.one == 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \t\n\x0b\x1c\x85\xa0 　ab.é"), max_size=20), min_size=30, max_size=40))
def test_blanks_as_in_python(spark, texts):
    assert column(spark, texts, blank_words) == [t.split() for t in texts]
    assert column(spark, texts, strip_blanks) == [t.strip() for t in texts]


HTML = {
    "<p>a<b>c</b></p>": "a\nc",
    "<nav>x<nav>y</nav>z</nav>k": "k",
    "<nav>open a": "",
    "a<!-- <p>no</p> -->b": "a\nb",
    "<script>var t='</p>';</script>z": "z",
    "a &amp; b &lt;i&gt; &copy;&euro;": "a & b <i> ©€",
    "AT&T &unknown; x": "AT&T &unknown; x",
    "": "",
    "<a title='1>2'>q</a>": "q",
    "1 < 2 and <b>3</b>": "1 < 2 and\n3",
    "<header>h<p>i</header>k<footer/>l": "k\nl",
    "line one\n  line two <br>three": "line one\n  line two\nthree",
    "<template>t</template>u<ruby>v<rt>w</rt></ruby>": "u\nv",
    "<navx>kept</navx>": "kept",
    "caf&eacute; &mdash; &#8364;&#x20ac; &#128; &#65a &#; &copy. &notit; &amp;lt; &lt&gt;": "caf\xe9 \u2014 \u20ac\u20ac \u20ac &#65a &#; &copy. &notit & lt;".replace("& lt;", "&lt; <>"),
    "&#0; &#xD800; &#x110000; &#99999999999; &#1; &#x1F600; &NotEqualTilde;.": "\ufffd \ufffd \ufffd \ufffd  \U0001F600 \u2242\u0338.",
    "<noscript>seen<p>too</noscript>!<template><p>t</p></template>": "seen\ntoo\n!",
    "x<ruby>v<rp>(</rp><rt>w</rt><rp>)</rp></ruby>": "x\nv",
    "<template><template>a</template>b</template>c": "c",
    "tail &eacute": "tail &eacute",
    "<div><nav></div>x</nav>y": "x\ny",
    "<nav><script>'</div>'</script><!-- </p> --></nav>y": "y",
}


def texts(spark, pages, engine):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    rows = H.html_to_text(df, "html", "text", engine).orderBy("i").collect()
    return [r.text for r in rows]


def test_html_edge_pages(spark):
    want = dict(HTML)
    want["AT&T &unknown; x"] = "AT&T &unknown; x".replace("&unknown;", "&unknown")
    assert texts(spark, list(HTML), "auto") == list(want.values())


def test_html_engines_agree(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    both = H.html_to_text(H.html_to_text(pages, "html", "a", "auto"), "html", "p", "parser")
    assert both.where("a <> p").count() == 0
    blocked = H.without_blocks(F.col("html"))
    hard = H.needs_parser(F.col("html"), blocked, F.regexp_replace(blocked, H.TAGS, H.MARK))
    assert pages.where(hard).count() < 0.1 * pages.count()


def test_references_and_silent_elements_need_no_parser(spark):
    """Pages dressed with references of every kind and with elements no page shows."""
    dress = "<p>&mdash;&eacute;&nbsp;&#8212;&#x20AC;&unknown; <noscript>n&hellip;</noscript><template><i>gone</i></template>"
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(F.replace("html", F.lit("<p>"), F.lit(dress)).alias("html"))
    both = H.html_to_text(H.html_to_text(pages, "html", "a", "auto"), "html", "p", "parser")
    assert both.where("a <> p").count() == 0 and both.where("contains(a, '\u2026')").count() > 100
    blocked = H.without_blocks(F.col("html"))
    hard = H.needs_parser(F.col("html"), blocked, F.regexp_replace(blocked, H.TAGS, H.MARK))
    assert pages.where(hard).count() < 0.05 * pages.count()


def test_null_page_is_null(spark):
    assert texts(spark, [None, "<p>a"], "auto") == [None, "a"]


def test_batches_are_signed_and_counted_in_slices(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from textloom.functions import minhash
    from textloom.operators import langid

    a, b = minhash.coefficients(4)
    lists = pa.array([["x"] * 3, None, [], ["y", "z"], ["x"], ["w"] * 9], pa.list_(pa.string()))
    whole = minhash.signatures(lists, a, b)
    monkeypatch.setattr(minhash, "WORDS_PER_SLICE", 3)
    parts = list(minhash._slices(lists))
    assert [len(p) for p in parts] == [1, 4, 1]
    assert (np.concatenate([minhash.signatures(p, a, b) for p in parts]) == whole).all()

    rows = pa.RecordBatch.from_arrays([
        pa.array(["en", "de", "en", None, "de", "en"]), pa.array([" abab ", " abab ", " abab ", " xyz ", None, "  "])], ["key", "text"])
    want = {}
    for lang, text in zip(*rows.to_pydict().values()):
        for gram, times in zip(*(v.tolist() for v in langid._codes(text or ""))):
            want[lang, gram] = want.get((lang, gram), 0) + times
    monkeypatch.setattr(langid, "SLICE_BYTES", 12)
    got = {}
    found = list(langid._rows_of_language(iter([rows])))
    for lang, gram, times in (r.values() for batch in found for r in batch.to_pylist()):
        got[lang, gram] = got.get((lang, gram), 0) + times
    assert got == want
    by_text = [batch.to_pylist() for batch in langid._rows_of_text(iter([rows]))]
    assert [len(p) for p in by_text] == [8, 9]
    assert [r for p in by_text for r in p if r["gram"] is None] == [
        {"key": "de", "gram": None, "times": 1}, {"key": "en", "gram": None, "times": 1}]
