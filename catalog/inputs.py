"""Queries over sources and sinks; files are written to the shared folder and read back."""
from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from catalog import base as B
from catalog import corpus
from catalog import scoring
from catalog import sql as S
from catalog import tokens
from catalog.tokens import PAIRS, sft_pairs
from textloom.functions.examples import pretrain_example
from textloom.functions.prompts import by_type
from textloom.functions.text import blank_words
from textloom.operators import vocab
from textloom.operators.spread import spread
from textloom.operators.storage import cut, scratch_path, stored
from textloom.plans import corpus as plans
from textloom.sources import jsonl, manifest, sinks, warc
from textloom.sources.files import file_system

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


def written(spark, df, name, write):
    """Write with ``write(df, path)`` and return the path."""
    path = scratch_path(spark, name)
    write(df, path)
    return path


# --- manifests and files ---------------------------------------------------------------

ENTRIES = "SELECT row_number() OVER (ORDER BY page_id) - 1 AS pos, url AS path FROM pages"


def entries(spark, sf):
    pages = B.table(spark, sf, "pages").select("page_id", F.concat(F.lit(" "), "url", F.lit("\t")).alias("value"))
    return manifest.manifest_entries(pages, order=["page_id"])


@query("scan_manifest", ENTRIES)
def _(spark, sf):
    # Several files in page order, one of their lines with blanks around the entry.
    pages = B.table(spark, sf, "pages").repartitionByRange(3, "page_id").sortWithinPartitions("page_id")
    lines = pages.select(F.concat(F.lit(" "), "url", F.lit("\t")).alias("value"))
    path = scratch_path(spark, "manifest")
    lines.write.option("compression", "gzip").text(path)
    return manifest.scan_manifest(spark, path)


@query("manifest_entries", ENTRIES)
def _(spark, sf):
    return entries(spark, sf)


@query("manifest_head", ENTRIES + " ORDER BY pos LIMIT 40")
def _(spark, sf):
    return manifest.manifest_head(entries(spark, sf), 40)


@query("scan_text_lines", """SELECT doc_id, (pos - 1)::INTEGER AS line_no, line AS value FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (
    SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents))""")
def _(spark, sf):
    docs = spread(B.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return jsonl.scan_text_lines(docs, "text", "doc_id")


@query("sink_text", """SELECT line AS value, count(*) AS n FROM (
  SELECT unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM documents) GROUP BY line""")
def _(spark, sf):
    path = written(spark, B.table(spark, sf, "documents"), "text", sinks.sink_text)
    return jsonl.read_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("scan_binary", "SELECT page_id || '.html' AS name, strlen(html) AS length, md5(html) AS digest FROM pages")
def _(spark, sf):
    pages = spread(B.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    path = scratch_path(spark, "binary")
    files = pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    write_files(files, path).agg(F.sum("bytes")).collect()
    return warc.scan_binary(spark, path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.md5("content").alias("digest"))


def write_files(files, path):
    """Write (name, content) rows as files below a shared folder; returns (name, bytes)."""
    def put(batches):
        import pandas as pd

        filesystem, root = file_system(path)
        filesystem.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                with filesystem.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content)
            yield pd.DataFrame({"name": batch["name"], "bytes": batch["content"].map(len)})

    return files.mapInPandas(put, "name string, bytes long")


def http_block(html, status):
    head = F.concat(F.lit("HTTP/1.1 "), status, F.lit(" X\r\nContent-Type: text/html\r\n\r\n"))
    return F.concat(head.cast("binary"), html.cast("binary"))


def write_archives(records, path, order="page_id"):
    """(uri, rec_type, block) rows as gzip archives with one member per record, in the order of a column."""
    def put(batches):
        import pandas as pd
        from pyspark import TaskContext

        filesystem, root = file_system(path)
        filesystem.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        with filesystem.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for uri, kind, block in zip(batch["uri"], batch["rec_type"], batch["block"]):
                    head = (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\n"
                            f"Content-Type: application/http; msgtype={kind}\r\nContent-Length: {len(block)}\r\n\r\n")
                    out.write(gzip.compress(head.encode() + block + b"\r\n\r\n", 1))
        yield pd.DataFrame({"name": [name]})

    ordered = records.repartitionByRange(2, order).sortWithinPartitions(order, "rec_type")
    return ordered.mapInPandas(put, "name string")


# Far below the size of a split in use, so that one archive of the small tables fills several tasks.
SMALL_SPLIT = 1 << 17


def page_archives(spark, sf):
    """All pages with a request each, in a few archives."""
    pages = B.table(spark, sf, "pages").select("page_id", F.col("url").alias("uri"), "html")
    answers = pages.select("page_id", "uri", F.lit("response").alias("rec_type"), http_block(F.col("html"), F.lit("200")).alias("block"))
    requests = pages.select("page_id", "uri", F.lit("request").alias("rec_type"), F.concat(F.lit("GET "), "uri").cast("binary").alias("block"))
    return written(spark, answers.unionByName(requests), "archive", lambda df, path: write_archives(df, path).collect())


ARCHIVED = """SELECT url AS uri, 'response' AS rec_type, '200' AS http_status, md5(html) AS digest FROM pages
  UNION ALL SELECT url, 'request', NULL, md5('GET ' || url) FROM pages"""


@query("scan_web_archive", ARCHIVED)
def _(spark, sf):
    return warc.scan_web_archive(spark, page_archives(spark, sf), split_bytes=SMALL_SPLIT).where("error is null").select(
        "uri", "rec_type", "http_status", F.md5("body").alias("digest"))


@query("scan_web_archive_responses", f"SELECT uri, digest FROM ({ARCHIVED}) WHERE rec_type = 'response' AND http_status = '200'")
def _(spark, sf):
    """The filter runs on the index, so that no byte of other records is read again."""
    found = warc.scan_web_archive(spark, page_archives(spark, sf), "rec_type = 'response' AND http_status = '200'", split_bytes=SMALL_SPLIT)
    return found.select("uri", F.md5("body").alias("digest"))


@query("archive_index", f"SELECT uri, rec_type, http_status FROM ({ARCHIVED})")
def _(spark, sf):
    return warc.archive_index(spark, page_archives(spark, sf), SMALL_SPLIT).select("uri", "rec_type", "http_status")


def _of(sql: str, table: str) -> str:
    return sql.replace("documents", table)


PIPELINE = "WITH RECURSIVE " + ",\n".join((
    corpus.RECORDS, corpus.MODEL,
    f"""texts AS MATERIALIZED (SELECT page_id, text FROM (SELECT page_id, {corpus.page_text('body')} AS text FROM answered)
  WHERE length(text) BETWEEN 256 AND 100000)""", corpus.scored("texts", "page_id", "text"),
    "cleaned AS MATERIALIZED (SELECT page_id AS doc_id, text FROM texts JOIN predicted USING (page_id) WHERE predicted IN ('en', 'de'))",
    _of(corpus.SIGNATURES, "cleaned"), corpus.EDGES, corpus.COMPONENTS,
    "firsts AS MATERIALIZED (SELECT doc_id, text FROM cleaned JOIN components ON node = doc_id WHERE node = component)",
    _of(tokens.vocab_sql(), "firsts"), tokens.ids_of("firsts", "doc_id", S.words("text"))))


@query("run_pipeline", PIPELINE + f" SELECT array_to_string(ids[1:{tokens.MAX_LENGTH}], ' ') AS input_ids FROM ids")
def _(spark, sf):
    """All stages from archives of pages to token ids, each finished once."""
    root = scratch_path(spark, "corpus")
    records = B.web_records(spark, sf).select(
        "page_id", F.col("url").alias("uri"), "rec_type",
        http_block(F.col("body"), F.coalesce("http_status", F.lit("none"))).alias("block"))
    names = write_archives(records, f"{root}/web").collect()
    spark.createDataFrame(names, "value string").coalesce(1).write.text(f"{root}/paths")
    model = written(spark, corpus.language_model(spark, sf), "model", lambda df, path: df.write.parquet(path))
    plans.run_corpus(spark, plans.CorpusConfig(
        plans.DownloadConfig(f"{root}/paths", f"{root}/web/", len(names), f"{root}/raw", 4),
        plans.CleanConfig(f"{root}/raw", f"{root}/clean", language_model=model, language_whitelist=["en", "de"]),
        plans.DedupConfig(f"{root}/clean", f"{root}/unique"),
        plans.TokenizeConfig(f"{root}/unique", f"{root}/tokens", max_length=tokens.MAX_LENGTH)))
    return spark.read.parquet(f"{root}/tokens").select(tokens.joined(F.col("input_ids")).alias("input_ids"))


@query("fetch_report", "SELECT 'pages/' || page_id || '.html' AS path, 'SUCCESS' AS status, strlen(html) AS bytes FROM pages"
       " UNION ALL SELECT 'pages/missing.html', 'FAILURE', NULL")
def _(spark, sf):
    pages = spread(B.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    root = scratch_path(spark, "fetch")
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    write_files(pages.select(name.alias("name"), F.col("html").cast("binary").alias("content")),
                f"{root}/pages").agg(F.sum("bytes")).collect()
    write_files(spark.range(1).select(F.lit("empty").alias("name"), F.lit("").cast("binary").alias("content")),
                f"{root}/fetched").collect()
    wanted = pages.select(F.concat(F.lit("pages/"), name).alias("path")).union(
        spark.range(1).select(F.lit("pages/missing.html")))
    report = manifest.fetch_report(wanted, f"{root}/fetched", f"{root}/", 8)
    return report.select("path", "status", "bytes")


# --- JSON Lines ------------------------------------------------------------------------

# A digest decides which lines are damaged, lack a field, or hold a list.
JSON_TEXT = "substr(md5('j:' || doc_id), 1, 1)"


def json_lines(spark, sf):
    docs = spread(B.table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id")
    h = F.substring(B.digest("j", "doc_id"), 1, 1)
    whole = F.to_json(F.struct("text", F.col("source").alias("label")))
    line = by_type(h, {
        "0": F.concat(F.lit("  "), F.substring(whole, F.lit(2), F.length(whole))),
        "1": F.to_json(F.struct(F.col("text").alias("body"))),
        "2": F.to_json(F.struct(blank_words(F.col("text")).alias("text"))),
        "3": F.to_json(F.struct(F.array("doc_id", F.lit(7)).alias("text"))),
        "6": F.concat(F.lit('{"text": ['), F.col("doc_id").cast("string"), F.lit(', "7", "of", 4]}')),
        "7": F.lit('{"text": 5}'),
        "4": F.concat(F.lit("["), whole, F.lit("]")),
        "5": F.lit('{"text": null}'),
        # The last of repeated keys counts; NaN is a number, and so an unknown word inside a list.
        "8": F.concat(F.lit('{"text": "first", '), F.substring(whole, F.lit(2), F.length(whole))),
        "9": F.lit('{"text": NaN}'),
        "a": F.concat(F.lit('{"score": [NaN, -Infinity], "more": {"a": 1, "a": 2}, '), F.substring(whole, F.lit(2), F.length(whole))),
        "b": F.concat(F.lit('{"score": INF, '), F.substring(whole, F.lit(2), F.length(whole))),
    }, F.concat(F.lit(" "), whole, F.lit(" ")))
    return docs.select("doc_id", line.alias("value"))


@query("scan_jsonl_pretrain", f"""SELECT doc_id, CASE WHEN h NOT IN ('2', '3', '5', '6', '7', '9') THEN text END AS text,
  CASE WHEN h IN ('5', '7', '9') THEN NULL WHEN h = '3' THEN '' WHEN h = '6' THEN '7 of' ELSE array_to_string({S.words('text')}, ' ') END AS tokens,
  CASE WHEN h = '3' THEN doc_id || ' 7' WHEN h = '6' THEN doc_id || ' 4' WHEN h = '2' THEN '' END AS ids,
  CASE WHEN h NOT IN ('2', '3', '5', '6', '7', '9') THEN source END AS label
  FROM (SELECT *, {JSON_TEXT} AS h FROM documents) WHERE h NOT IN ('0', '1', '4', 'b')""")
def _(spark, sf):
    out = jsonl.scan_jsonl_pretrain(json_lines(spark, sf), "value", "doc_id")
    return out.select("doc_id", "text", F.array_join("tokens", " ").alias("tokens"),
                      F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), "label")


# Every id of the vocabulary, and so every id that a list may give, is below this.
MODEL_SIZE = "(SELECT max(id) + 1 FROM vocab)"


def _given(value: str) -> str:
    return f"CASE WHEN {value} < {MODEL_SIZE} THEN {value} ELSE 3 END"


def _word_id(word: str) -> str:
    return f"(SELECT coalesce(max(id), 3) FROM vocab WHERE token = '{word}')"


@query("pretrain_from_json", tokens.DOC_IDS + f"""SELECT doc_id, array_to_string(x, ' ') AS input_ids,
  array_to_string(list_transform(x, lambda i: CASE WHEN i = 0 THEN 0 ELSE 1 END), ' ') AS attention_mask,
  array_to_string(list_transform(x, lambda i: CASE WHEN i = 0 THEN -100 ELSE i END), ' ') AS labels
  FROM (SELECT doc_id, {tokens.padded(f'given[1:{tokens.MAX_LENGTH}]')} AS x FROM (
    SELECT doc_id, CASE WHEN h IN ('5', '7', '9') THEN []::BIGINT[] WHEN h = '3' THEN [{_given('doc_id')}, {_given('7')}]
      WHEN h = '6' THEN [{_given('doc_id')}, {_word_id('7')}, {_word_id('of')}, {_given('4')}] ELSE ids END AS given
    FROM (SELECT doc_id, {JSON_TEXT} AS h FROM documents) JOIN ids USING (doc_id) WHERE h NOT IN ('0', '1', '4', 'b')))""")
def _(spark, sf):
    """Lines to examples with every word of the documents; integers of a list are ids already."""
    rows = jsonl.scan_jsonl_pretrain(json_lines(spark, sf), "value", "doc_id")
    words = stored(tokens.corpus_vocab(spark, sf), "vocab")
    size = vocab.vocab_size(words).first()["size"]
    found = vocab.token_ids(rows, F.col("tokens"), words, "found")
    ids = vocab.with_given_ids(F.col("found"), F.col("ids"), size)
    ids = F.coalesce(ids, F.array().cast("array<int>"))
    return tokens.flat_example(found.select("doc_id", pretrain_example(ids, tokens.MAX_LENGTH).alias("x")), "doc_id")


@query("jsonl_rejects", f"""SELECT count(*) AS lines, count(*) FILTER ({JSON_TEXT} IN ('0', '4', 'b')) AS bad_json,
  count(*) FILTER ({JSON_TEXT} = '1') AS missing_field FROM documents""")
def _(spark, sf):
    return jsonl.line_rejects(json_lines(spark, sf), ["text"])


@query("scan_jsonl_sft", S.with_(PAIRS) + """SELECT conv_id, turn, instruction, output FROM pairs
  WHERE substr(md5('j:' || conv_id || ':' || turn), 1, 1) NOT IN ('0', '1')""")
def _(spark, sf):
    h = F.substring(B.digest("j", "conv_id", "turn"), 1, 1)
    whole = F.to_json(F.struct("instruction", "output"))
    line = by_type(h, {
        "0": F.concat(whole, F.lit("}")), "1": F.to_json(F.struct("instruction")),
        "2": F.concat(F.lit('{"output": "none", "reward": NaN, '), F.substring(whole, F.lit(2), F.length(whole))),
    }, whole)
    pairs = sft_pairs(spark, sf).select("conv_id", "turn", line.alias("value"))
    return jsonl.scan_jsonl_sft(pairs, "value", "conv_id", "turn")


@query("scan_seed_tasks", f"""SELECT item_id, kind AS type, text AS task FROM (
  SELECT *, {S.draw_type(S.uniform("'seedtype'", "item_id"))} AS kind, substr(md5('j:' || item_id), 1, 1) AS h FROM benchmark)
  WHERE h NOT IN ('0', '1', '2')""")
def _(spark, sf):
    h = F.substring(B.digest("j", "item_id"), 1, 1)
    seeds = scoring.seeds(spark, sf)
    known = F.to_json(F.struct("type", "task"))
    line = by_type(h, {
        "0": F.lit("{broken"), "1": F.to_json(F.struct("type")),
        "2": F.to_json(F.struct(F.lit("guessing").alias("type"), "task")),
        "3": F.concat(F.lit('{"type": "guessing", "task": {"a": 1, "a": 2}, "limit": Infinity, '), F.substring(known, F.lit(2), F.length(known))),
    }, known)
    return jsonl.scan_seed_tasks(seeds.select("item_id", line.alias("value")), "value", "item_id")


# --- sinks -----------------------------------------------------------------------------


@query("sink_tokens", tokens.DOC_IDS + "SELECT doc_id, array_to_string(ids, ' ') AS input_ids FROM ids")
def _(spark, sf):
    """Ids of whole texts written and read back, compared by value."""
    ids = tokens.doc_ids(spark, sf).withColumnRenamed("ids", "input_ids")
    path = written(spark, ids, "tokens", sinks.sink_tokens)
    return spark.read.schema("doc_id bigint, input_ids array<int>").parquet(path).select(
        "doc_id", tokens.joined(F.col("input_ids")).alias("input_ids"))


@query("sink_task_records", S.with_(S.TASKS, S.VALIDATED_TASKS, S.ACCEPTED_TASKS)
       + "SELECT iteration, seq, task, is_valid FROM gated")
def _(spark, sf):
    records = cut(scoring.checked_tasks(spark, sf).select("iteration", "seq", "task", "validation"))
    path = written(spark, records, "records", sinks.sink_task_records)
    back = spark.read.schema(
        "iteration long, seq long, task string, validation struct<is_valid: boolean>, timestamp string").json(path)
    return back.where("timestamp is not null").select("iteration", "seq", "task", "validation.is_valid")


@query("sink_run_metrics", scoring.SUMMARY + "SELECT metric, round(value + 1e-9, 6) AS value FROM lines")
def _(spark, sf):
    path = written(spark, scoring.summary(spark, sf), "metrics", sinks.sink_run_metrics)
    return sinks.load_run_metrics(spark, path).withColumn("value", scoring.r6(F.col("value")))
