"""Queries over documents and pages: cleaning, language, near-duplicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog import sql as S
from textloom.functions import html as H
from textloom.functions.fixed_values import NON_CONTENT_TAGS
from textloom.functions.minhash import coefficients, lsh_bands, minhash_signature
from textloom.functions.text import normalize_text, shingle_words
from textloom.operators import cleaning, dedup, langid
from textloom.operators.graph import component_representative, connected_components
from textloom.operators.spread import spread
from textloom.operators.storage import cut

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


def documents(spark, sf, *columns):
    return spread(B.table(spark, sf, "documents").select("doc_id", "text", *columns), "doc_id")


# --- cleaning --------------------------------------------------------------------------

RECORDS = """records AS (SELECT page_id, url, html AS body,
  CASE WHEN substr(md5(url), 1, 1) = '0' THEN 'request' ELSE 'response' END AS rec_type,
  CASE substr(md5(url), 1, 1) WHEN '1' THEN '404' WHEN '2' THEN NULL ELSE '200' END AS http_status FROM pages),
answered AS (SELECT * FROM records WHERE rec_type = 'response' AND http_status = '200' AND length(body) > 0)"""


@query("filter_response", S.with_(RECORDS) + "SELECT page_id, rec_type, http_status FROM answered")
def _(spark, sf):
    return cleaning.filter_response(B.web_records(spark, sf)).select("page_id", "rec_type", "http_status")


def page_text(html: str) -> str:
    blocks = "(?is)<!--.*?-->" + "".join(
        rf"|<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in NON_CONTENT_TAGS)
    tags = "(?s)</?[a-zA-Z][^>]*>|<!(?i:doctype)[^>]*>"
    text = f"regexp_replace(regexp_replace({html}, {S.lit(blocks)}, chr(1), 'g'), {S.lit(tags)}, chr(1), 'g')"
    for entity, char in H.ENTITIES.items():  # a cut title may lack the semicolon
        text = f"regexp_replace({text}, {S.lit(entity + '?')}, {S.lit(char)}, 'g')"
    return (f"array_to_string(list_filter(list_transform(string_split({text}, chr(1)),"
            f" lambda n: {S.strip('n')}), lambda n: n <> ''), chr(10))")


@query("html_to_text", f"SELECT page_id, {page_text('html')} AS text FROM pages")
def _(spark, sf):
    pages = spread(B.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return H.html_to_text(pages, "html").select("page_id", "text")


@query("filter_length", "SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE length(text) BETWEEN 256 AND 100000")
def _(spark, sf):
    return cleaning.filter_length(B.table(spark, sf, "documents")).select(
        "doc_id", F.length("text").cast("long").alias("chars"))


@query("filter_language", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def _(spark, sf):
    return langid.filter_language(B.table(spark, sf, "documents"), F.col("lang"), ["en", "fr"]).select("doc_id", "lang")


def pieces(table: str, key: str, text: str, *more: str) -> str:
    """Trigram rows of a text column."""
    keep = ", ".join((key, *more))
    return f"""SELECT {keep}, unicode(c[i])::BIGINT * 4398046511104 + unicode(c[i + 1])::BIGINT * 2097152
        + unicode(c[i + 2])::BIGINT AS gram FROM (
      SELECT {keep}, c, unnest(range(1, len(c) - 1)) AS i FROM (
        SELECT {keep}, string_split(' ' || trim(regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g'), ' ') || ' ', '') AS c
        FROM {table}))"""


MODEL = f"""counts AS MATERIALIZED (SELECT lang, gram, count(*) AS n FROM ({pieces('documents', 'doc_id', 'text', 'lang')}) GROUP BY ALL),
totals AS MATERIALIZED (SELECT lang, sum(n) AS total, count(*) AS kinds FROM counts GROUP BY lang),
bases AS MATERIALIZED (SELECT lang, round(ln(1.0::DOUBLE / (total + kinds + 1)) * 10000)::BIGINT AS base FROM totals),
gains AS MATERIALIZED (SELECT lang, gram, round(ln((n + 1.0::DOUBLE) / (total + kinds + 1)) * 10000)::BIGINT - base AS gain
  FROM counts JOIN totals USING (lang) JOIN bases USING (lang))"""


def scored(table: str, key: str, text: str) -> str:
    return f"""grams AS MATERIALIZED (SELECT {key}, gram, count(*) AS times FROM ({pieces(table, key, text)}) GROUP BY ALL),
sizes AS (SELECT {key}, sum(times) AS n FROM grams GROUP BY {key}),
gained AS (SELECT {key}, lang, sum(times * gain) AS gain FROM grams JOIN gains USING (gram) GROUP BY ALL),
scores AS (SELECT t.{key}, b.lang, coalesce(s.n, 1) * b.base + coalesce(g.gain, 0) AS score
  FROM (SELECT DISTINCT {key} FROM {table}) t CROSS JOIN bases b LEFT JOIN sizes s USING ({key})
  LEFT JOIN gained g ON g.{key} = t.{key} AND g.lang = b.lang),
predicted AS (SELECT {key}, first(lang ORDER BY score DESC, lang) AS predicted FROM scores GROUP BY {key})"""


def language_model(spark, sf):
    """Trained on all documents; a model is an input, so it is stored before use."""
    return cut(langid.train_language_model(B.table(spark, sf, "documents")))


# References of every kind and elements without text, put behind every paragraph mark.
DRESS = "<p>&mdash;&eacute;&#8212;&#x20AC;&unknown; <noscript>n&hellip;</noscript><template><i>gone</i></template>"
DRESSED_TEXT = page_text("replace(html, '<p>', '<p>\u2014\xe9\u2014\u20ac&unknown <b>n\u2026</b>')")


@query("html_to_text_references", f"SELECT page_id, {DRESSED_TEXT} AS text FROM pages")
def _(spark, sf):
    pages = spread(B.table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("<p>"), F.lit(DRESS)).alias("html")), "page_id")
    return H.html_to_text(pages, "html").select("page_id", "text")


@query("train_language_model", S.with_(MODEL) + "SELECT lang, gram, gain + base AS logp FROM gains JOIN bases USING (lang)")
def _(spark, sf):
    return langid.train_language_model(B.table(spark, sf, "documents")).where("gram is not null")


@query("lang_identify", S.with_(MODEL, scored("documents", "doc_id", "text")) + "SELECT doc_id, predicted FROM predicted")
def _(spark, sf):
    docs = documents(spark, sf)
    return langid.lang_identify(docs, language_model(spark, sf)).select("doc_id", "predicted")


@query("lang_identify_join", S.with_(MODEL, scored("documents", "doc_id", "text"))
       + "SELECT CASE WHEN doc_id % 5 > 0 THEN doc_id // 3 END AS key, md5(text) AS digest, predicted FROM documents JOIN predicted USING (doc_id)")
def _(spark, sf):
    """A model joined by shuffle, with ids that are null or repeated."""
    docs = documents(spark, sf).select(
        F.when(F.col("doc_id") % 5 > 0, F.floor(F.col("doc_id") / 3)).alias("key"), F.md5("text").alias("digest"), "text")
    found = langid.lang_identify(docs, language_model(spark, sf), "key", max_cells=0)
    return found.select("key", "digest", "predicted")


@query("top1_language", S.with_(MODEL, scored("conversations", "conv_id", "text").replace(
    "conv_id", "key").replace("FROM conversations", "FROM (SELECT conv_id * 1000000 + turn AS key, text FROM conversations)"))
    + "SELECT key, predicted FROM predicted")
def _(spark, sf):
    turns = B.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("key"), "text")
    scores, languages = langid.lang_scores(turns, language_model(spark, sf), "key")
    return langid.top1_language(scores, languages, "key")


@query("clean_documents", S.with_(RECORDS, MODEL, f"""texts AS MATERIALIZED (
  SELECT page_id, text FROM (SELECT page_id, {page_text('body')} AS text FROM answered) WHERE length(text) BETWEEN 256 AND 100000)""",
    scored("texts", "page_id", "text")) + "SELECT page_id, text FROM texts JOIN predicted USING (page_id) WHERE predicted IN ('en', 'de')")
def _(spark, sf):
    return cleaning.clean_documents(
        B.web_records(spark, sf), "page_id", "body", language_model(spark, sf), ["en", "de"])


# --- shingles --------------------------------------------------------------------------

CLEANED = r"regexp_replace(lower(text), '[^\w \t\n\x0b\f\r]', '', 'g')"
SHINGLES = rf"list_distinct(regexp_split_to_array({CLEANED}, '[ \t\n\x0b\f\r]+'))"


@query("normalize_text", f"SELECT doc_id, {CLEANED} AS cleaned FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", normalize_text(F.col("text")).alias("cleaned"))


@query("shingle_words", f"""SELECT doc_id, len({SHINGLES})::BIGINT AS n,
  md5(array_to_string(list_sort({SHINGLES}), ' ')) AS digest FROM documents""")
def _(spark, sf):
    shingled = documents(spark, sf).select("doc_id", shingle_words(F.col("text")).alias("s"))
    return shingled.select("doc_id", F.size("s").cast("long").alias("n"),
                           F.md5(F.array_join(F.array_sort("s"), " ")).alias("digest"))


@query("filter_nonempty_shingles", f"SELECT doc_id FROM documents WHERE len({SHINGLES}) > 0")
def _(spark, sf):
    return documents(spark, sf).where(F.size(shingle_words(F.col("text"))) > 0).select("doc_id")


# --- MinHash and near-duplicates -------------------------------------------------------

NUM_PERM, BANDS, ROWS = 128, 9, 13


def signature_sql() -> str:
    a, b = coefficients(NUM_PERM)
    permuted = ", ".join(
        f"((h * {x}::HUGEINT + {y}) % 18446744073709551616 % 2305843009213693951 % 4294967296)::BIGINT AS p{i}"
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    minima = ", ".join(f"min(p{i})" for i in range(NUM_PERM))
    return f"""doc_words AS MATERIALIZED (SELECT doc_id, unnest({SHINGLES}) AS w FROM documents),
hashed AS (SELECT w, ('0x' || s[7:8] || s[5:6] || s[3:4] || s[1:2])::BIGINT::HUGEINT AS h
  FROM (SELECT w, sha1(w) AS s FROM (SELECT DISTINCT w FROM doc_words))),
permuted AS MATERIALIZED (SELECT w, {permuted} FROM hashed),
signatures AS MATERIALIZED (SELECT doc_id, [{minima}] AS sig FROM doc_words JOIN permuted USING (w) GROUP BY doc_id)"""


SIGNATURES = signature_sql()
BAND_KEYS = "[" + ", ".join(
    f"md5('{i},' || array_to_string(sig[{i * ROWS + 1}:{(i + 1) * ROWS}], ','))" for i in range(BANDS)) + "]"
EDGES = f"""bands AS MATERIALIZED (SELECT doc_id, unnest({BAND_KEYS}) AS bucket FROM signatures),
wholes AS (SELECT doc_id, md5(array_to_string(sig[1:{BANDS * ROWS}], ',')) AS whole FROM signatures),
nodes AS MATERIALIZED (SELECT whole, min(doc_id) AS id, count(*) AS copies FROM wholes GROUP BY whole),
node_bands AS MATERIALIZED (SELECT n.id, b.bucket FROM nodes n JOIN bands b ON b.doc_id = n.id),
anchors AS (SELECT bucket, min(id) AS src FROM node_bands GROUP BY bucket HAVING count(*) > 1),
edges AS MATERIALIZED (SELECT DISTINCT a.src, b.id AS dst FROM anchors a JOIN node_bands b USING (bucket) WHERE b.id <> a.src)"""
# Components from all pairs of documents that share a bucket, copies not collapsed.
COMPONENTS = """links AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y USING (bucket)),
reach(node, root) AS (SELECT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
components AS MATERIALIZED (SELECT node, min(root) AS component, count(*) AS size FROM reach GROUP BY node)"""


def dedup_sql(select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((SIGNATURES, EDGES, COMPONENTS)) + "\n" + select


@query("minhash_signature", S.with_(SIGNATURES) + "SELECT doc_id, array_to_string(sig, ',') AS signature FROM signatures")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(
        minhash_signature(shingle_words(F.col("text")), NUM_PERM).cast("array<string>"), ",").alias("signature"))


@query("lsh_bands", S.with_(SIGNATURES, EDGES) + "SELECT doc_id, bucket FROM bands")
def _(spark, sf):
    signed = documents(spark, sf).select("doc_id", minhash_signature(shingle_words(F.col("text")), NUM_PERM).alias("s"))
    return signed.select("doc_id", F.explode(lsh_bands(F.col("s"), BANDS, ROWS)).alias("b")).select(
        "doc_id", F.lower(F.hex("b")).alias("bucket"))


def candidate_edges(spark, sf):
    signed = cut(dedup.signed(B.table(spark, sf, "documents")))
    return dedup.lsh_candidates(dedup.one_per_signature(signed), signed.count() * BANDS)


@query("lsh_candidates", S.with_(SIGNATURES, EDGES) + "SELECT src, dst FROM edges")
def _(spark, sf):
    return candidate_edges(spark, sf)


@query("distinct_clusters", S.with_(SIGNATURES, EDGES) + """SELECT bucket, min(id) AS anchor, count(*) AS members
  FROM node_bands GROUP BY bucket HAVING count(*) > 1""")
def _(spark, sf):
    signed = cut(dedup.signed(B.table(spark, sf, "documents")))
    return dedup.band_buckets(dedup.one_per_signature(signed)).select(
        F.lower(F.hex("bucket")).alias("bucket"), "anchor", "members")


@query("exact_jaccard_pairs", S.with_(SIGNATURES, EDGES, f"sets AS MATERIALIZED (SELECT doc_id, {SHINGLES} AS s FROM documents)")
       + f"""SELECT src, dst, round({S.jaccard('x.s', 'y.s')}, 6) AS jaccard FROM edges
  JOIN sets x ON x.doc_id = src JOIN sets y ON y.doc_id = dst""")
def _(spark, sf):
    edges = candidate_edges(spark, sf)
    found = dedup.edge_similarity(edges, B.table(spark, sf, "documents"))
    return found.withColumn("jaccard", F.round("jaccard", 6))


def duplicates(spark, sf):
    return dedup.Duplicates(B.table(spark, sf, "documents"), num_perm=NUM_PERM)


@query("connected_components", dedup_sql(
    "SELECT node, component FROM components WHERE node IN (SELECT src FROM edges UNION SELECT dst FROM edges)"))
def _(spark, sf):
    return connected_components(candidate_edges(spark, sf))


@query("component_representative", dedup_sql("""SELECT component, component AS representative, count(*) AS size
  FROM components WHERE size > 1 GROUP BY component"""))
def _(spark, sf):
    return component_representative(duplicates(spark, sf).clusters().withColumnRenamed("id", "node"))


@query("near_dup_clusters", dedup_sql("SELECT node AS id, component FROM components WHERE size > 1"))
def _(spark, sf):
    return duplicates(spark, sf).clusters()


@query("sorted_cluster", dedup_sql("""SELECT component, node AS id,
  row_number() OVER (ORDER BY component, node) - 1 AS pos FROM components WHERE size > 1"""))
def _(spark, sf):
    return dedup.sorted_clusters(duplicates(spark, sf).clusters())


@query("join_representatives", dedup_sql("""SELECT d.doc_id, d.text FROM documents d JOIN components c ON c.node = d.doc_id
  WHERE size > 1 AND component = node"""))
def _(spark, sf):
    found = duplicates(spark, sf)
    return dedup.representatives(found).select("doc_id", "text")


@query("anti_duplicates", dedup_sql("SELECT doc_id, text FROM documents JOIN components ON node = doc_id WHERE size = 1"))
def _(spark, sf):
    return dedup.unclustered(duplicates(spark, sf)).select("doc_id", "text")


KEPT = "SELECT doc_id, text FROM documents JOIN components ON node = doc_id WHERE node = component"


@query("union_survivors", dedup_sql(KEPT))
def _(spark, sf):
    found = duplicates(spark, sf)
    return dedup.unclustered(found).unionByName(dedup.representatives(found)).select("doc_id", "text")


@query("dedup_documents", dedup_sql(KEPT))
def _(spark, sf):
    return dedup.dedup_documents(B.table(spark, sf, "documents")).select("doc_id", "text")


@query("dedup_stats", dedup_sql("""SELECT count(*) AS documents, count(*) FILTER (size > 1) AS clustered,
  count(DISTINCT component) FILTER (size > 1) AS components,
  count(*) FILTER (node <> component) AS dropped, count(*) FILTER (node = component) AS kept FROM components"""))
def _(spark, sf):
    return dedup.dedup_stats(duplicates(spark, sf))
