"""Small tables with every edge case the operators define."""
import pytest

EXTRA = "id string, h int, row string, n int, value double, n_words string, starts string, key string, quality string"


def words(seed: int, n: int) -> str:
    state, out = seed * 7919 + 1, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append("w%d" % (state >> 12 & 4095))
    return " ".join(out)


def edge_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, one very long text, copies, near copies,
    shared passages, a repeated row, and one id with two texts."""
    base, passage = words(1, 120), words(2, 60)
    changed = base.split()
    changed[60] = "other"
    long = words(3, 30_000)
    rows = [
        (0, base), (1, base), (2, " ".join(changed)), (3, words(4, 30) + " " + passage + " " + words(5, 30)),
        (4, words(6, 20) + "\n" + passage + "\n" + words(7, 20)), (5, ""), (6, None), (7, "  \n \t\n"), (8, "one"), (9, "one two"),
        (10, "One TWO"), (11, long), (12, long[:80_000]), (13, "Ça et là Ñandú über straße"), (14, "a b c a b c a b c a b c a b c a b c"),
        (15, "same line here\nsecond line there\nthird line now\nsame line here\nsecond line there\nthird line now\nlast"),
        (16, "x\n\n\n\n\n\ny"), (17, words(8, 40)), (17, words(8, 40)), (18, words(9, 40)), (18, words(10, 40)), (None, words(11, 40)),
        (None, None), (19, "don't  stop   at 12,345.67 !!! 　 \x1c x\x85y 日本語テキスト " + "z" * 700 + " " + "\U0001F600" * 5),
        (20, "a" * 3000 + "b" * 500), (21, "### spam $$$ ### buy $$$ ### spam $$$"),
        (22, "a <|endoftext|> b<|startoftext|>"),
    ]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, "en", "s", len(t) if t else None, *["clash"] + [1, "x", 2, .5, "w", "s", "k", "q"]) for i, t in edge_rows()]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}
