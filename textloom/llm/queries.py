"""Registered queries of the operators of this package and their DuckDB counterparts."""
from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.byte_bpe import encode_bpe
from textloom.llm.exact_dedup import exact_groups
from textloom.llm.fill_in_middle import fill_in_middle, restored
from textloom.llm.filter_audit import filter_audit
from textloom.llm.jaccard import JaccardRule, jaccard_components
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.packing import pack_documents
from textloom.llm.pseudonyms import pseudonymise
from textloom.llm.quality import fit_quality, held_out, score_quality
from textloom.llm.repetition import repetition_rules
from textloom.llm.source_mixing import mix_sources
from textloom.llm.substring_dedup import joined_words, remove_repeats
from textloom.llm.token_files import file_positions, write_token_files
from textloom.operators.storage import scratch_path

# Ends each document in token files and packed sequences.
END_ID = 2


def pseudonym_key(spark: SparkSession) -> str:
    """The secret of the pseudonyms; a deployment sets its own."""
    return spark.conf.get("spark.textloom.pseudonymKey", "no secret: set spark.textloom.pseudonymKey")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def quality_scores(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Scores of ``docs`` by a machine fitted on labelled documents that are not held out."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~held_out())
    return score_quality(docs, fit_quality(documents(spark, sf), labels))


def op1_factorisation_machine(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(spark, documents(spark, sf), sf).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_heavy_light_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(documents(spark, sf), JaccardRule(words=3, percent=90)).select(
        "doc_id", "n_shingles", "component_id", "n_links")


def op3_token_orc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    write_token_files(documents(spark, sf), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return file_positions(spark, path)


def op4_vector_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", F.crc32("ids").alias("ids_crc32"))


def op5_line_windows(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_lines(documents(spark, sf), lines_col="n_lines", removed_col="n_removed").select(
        "doc_id", "text", "n_lines", "n_removed")


def op6_repetition_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return repetition_rules(documents(spark, sf))


def op7_feistel_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonymise(documents(spark, sf), pseudonym_key(spark), count_col="n_replaced").select(
        "doc_id", "text", "n_replaced")


def op8_seed_and_extend(spark: SparkSession, sf: str) -> DataFrame:
    def digest(words: list[bytes]) -> bytes:
        return hashlib.sha256(joined_words(words)).hexdigest().encode()

    return remove_repeats(documents(spark, sf), finish=digest).select(
        "doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(documents(spark, sf)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_bpe(documents(spark, sf), ranks, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_learned_rank_index(spark: SparkSession, sf: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_sainte_lague(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


def op13_byte_transducer(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")).drop("filter")


QUERIES = {f.__name__: f for f in (
    op1_factorisation_machine, op2_heavy_light_join, op3_token_orc, op4_vector_packing, op5_line_windows, op6_repetition_coverage, op7_feistel_pseudonyms, op8_seed_and_extend, op9_exact_dedup, op10_byte_bpe,
    op11_learned_rank_index, op12_sainte_lague, op13_byte_transducer,
)}

ORACLE = {
    "op5_line_windows": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents WHERE text IS NOT NULL),
        three AS (
            SELECT doc_id, pos, line, lead(line) OVER d AS line2, lead(line, 2) OVER d AS line3
            FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
        later AS (
            SELECT doc_id, pos FROM (
                SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, pos) AS k
                FROM three WHERE line3 IS NOT NULL AND trim(line || line2 || line3, ' ' || chr(9) || chr(13)) <> '')
            WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, pos + step AS pos FROM later, (VALUES (0), (1), (2)) AS steps(step)),
        kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.pos IS NULL) AS text,
                   count(*) AS n_lines, count(gone.pos) AS n_removed
            FROM lines LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
               coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN kept USING (doc_id)
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_learned_rank_index": """
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
        numbers AS (
            SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS two,
                   ('0x' || substr(h, 17, 8))::BIGINT % 100 AS three, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS four FROM drawn),
        cut AS (
            SELECT doc_id, text, n, least(one, two) AS a, greatest(one, two) AS b,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR three >= 90 THEN 'plain'
                        WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                   WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
                   ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM cut
    """,
    "op12_sainte_lague": r"""
        WITH sizes AS (
            SELECT doc_id, coalesce('1' || source, '2') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5('mix:' || doc_id) AS draw FROM documents),
        totals AS (
            SELECT sum(size)::BIGINT AS words, greatest(1, ceil(sum(size) / 4194304), ceil(count(*) / 65536))::BIGINT AS shards FROM sizes),
        placed AS (SELECT sizes.*, ('0x' || substr(draw, 1, 8))::BIGINT % shards AS shard FROM sizes, totals),
        cells AS (
            SELECT key, shard, sum(size)::BIGINT AS cell_size, ceil(sum(size) / 16)::BIGINT AS blocks FROM placed GROUP BY ALL),
        sources AS (
            SELECT key, sum(cell_size)::BIGINT AS source_size, 3 * sum(cell_size)::BIGINT AS most, 3 * sum(blocks)::BIGINT AS most_blocks,
                   1 + (row_number() OVER (ORDER BY key) - 1) % 3 AS weight FROM cells GROUP BY key),
        levels AS (
            SELECT *, coalesce(sum(most) OVER earlier, 0)::BIGINT AS most_before, coalesce(sum(weight) OVER earlier, 0)::BIGINT AS weight_before,
                   sum(weight) OVER ()::BIGINT AS weights
            FROM sources WINDOW earlier AS (ORDER BY most / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        filled AS (
            SELECT *, most * (weights - weight_before)::DOUBLE <= weight * (words - most_before)::DOUBLE AS is_full FROM levels, totals),
        targets AS (
            SELECT *, CASE WHEN is_full THEN most::DOUBLE ELSE
                       (weight * (words - coalesce(sum(most) FILTER (is_full) OVER (), 0)::BIGINT))
                       / (sum(weight) FILTER (NOT is_full) OVER ())::BIGINT END AS target FROM filled),
        source_quotients AS (
            SELECT key, row_number() OVER (ORDER BY -target / (2 * k + 1), key, k) AS rank
            FROM (SELECT key, target, unnest(range(2 * most_blocks + 2)) AS k FROM targets WHERE target > 0)),
        source_seats AS (
            SELECT key, least(count(*), any_value(most_blocks)) AS seats FROM source_quotients JOIN sources USING (key), totals
            WHERE rank <= round_even(words / 16, 0) GROUP BY key),
        cell_quotients AS (
            SELECT key, shard, row_number() OVER (PARTITION BY key ORDER BY -cell_size / (2 * k + 1), shard, k) AS rank
            FROM (SELECT key, shard, cell_size, unnest(range(6 * blocks + 2)) AS k FROM cells WHERE cell_size > 0)),
        cell_seats AS (
            SELECT key, shard, least(count(*), 3 * any_value(blocks)) AS won FROM cell_quotients JOIN source_seats USING (key)
            JOIN cells USING (key, shard) WHERE rank <= seats GROUP BY key, shard),
        plan AS (
            SELECT key, shard, source_size, target, greatest(blocks, 1) AS blocks, coalesce(won, 0) // greatest(blocks, 1) AS passes,
                   coalesce(won, 0) % greatest(blocks, 1) AS extra,
                   ('0x' || substr(md5('mix:' || key || ':' || shard), 1, 8))::BIGINT % greatest(blocks, 1) AS first
            FROM cells JOIN targets USING (key) LEFT JOIN cell_seats USING (key, shard)),
        lying AS (
            SELECT *, (sum(size) OVER (PARTITION BY key, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS begin FROM placed),
        edges AS (
            SELECT doc_id, size, source_size, target, passes, extra, first, blocks, unnest([begin, begin + size]) AS word, unnest([-1, 1]) AS sign
            FROM lying JOIN plan USING (key, shard)),
        chosen AS (
            SELECT *, (word // 16 * extra + first) // blocks AS here, ((word // 16 + 1) * extra + first) // blocks AS next FROM edges)
        SELECT doc_id, size, source_size, target, (size * any_value(passes) + sum(sign * (16 * here + word % 16 * (next - here))))::BIGINT AS taken
        FROM chosen GROUP BY doc_id, size, source_size, target
    """,
    "op13_byte_transducer": r"""
        WITH counted AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id, quality = 1 AS good, toxic = 1 AS bad
            FROM documents LEFT JOIN labels USING (doc_id)),
        failed AS (
            SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, concat(
                   CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
                   CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' END,
                   CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > least_id THEN 'E' END) AS fails
            FROM counted),
        patterns AS (SELECT part, fails, good, bad, count(*) AS n FROM failed GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        steps AS (
            SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
            FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)),
        judged AS (
            SELECT *, contains(fails, f) AS hit, translate(fails, earlier, '') <> fails AS gone FROM patterns, steps),
        summed AS (
            SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0)::BIGINT AS good_lost,
                   coalesce(sum(n) FILTER (hit AND NOT gone AND bad), 0)::BIGINT AS toxic_lost
            FROM judged GROUP BY part, filter_order, step, f)
        SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM summed
    """,
}
