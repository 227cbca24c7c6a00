"""Queries over vocabularies, token ids, examples, batches and chat prompts."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import base as B
from catalog import sql as S
from textloom.functions import examples as E
from textloom.functions import prompts as P
from textloom.functions.text import blank_words
from textloom.operators import chat, vocab
from textloom.operators.batches import ROUNDS, epoch_batches, number_rows, shard_batches
from textloom.operators.spread import spread
from textloom.operators.storage import cut, shared_dir, stored
from textloom.sources.files import file_system
from textloom.sources.vocab_file import scan_vocab_file

QUERIES, ORACLE = {}, {}
# The length examples are cut to by default; the short sizes serve the queries about cuts.
MAX_LENGTH = 2048
SHORT_VOCAB, SHORT_MODEL, SHORT_LENGTH = 2000, 1500, 64


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


def joined(ids):
    return F.array_join(ids.cast("array<string>"), " ")


# The vocabulary is the special tokens and the words of all documents, most frequent first.
def vocab_sql(size: int | None = None) -> str:
    cut_off = f"QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {size - 4}" if size else ""
    return f"""word_counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({S.words('text')}) AS token FROM documents)
  WHERE token NOT IN ('<pad>', '<bos>', '<eos>', '<unk>') GROUP BY token),
vocab AS MATERIALIZED (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 3)::BIGINT AS id FROM word_counts {cut_off}
  UNION ALL SELECT unnest(['<pad>', '<bos>', '<eos>', '<unk>']), unnest([0, 1, 2, 3]))"""


VOCAB, SMALL_VOCAB = vocab_sql(), vocab_sql(SHORT_VOCAB)


def corpus_vocab(spark, sf, size=None):
    return vocab.build_vocab(B.table(spark, sf, "documents"), "text", size)


def ids_of(source: str, key: str, tokens: str, name: str = "ids", model_size: int | None = None) -> str:
    """CTE with the id list of each row: unknown and too large ids are 3."""
    known = f"CASE WHEN v.id < {model_size} THEN v.id END" if model_size else "v.id"
    return f"""{name} AS MATERIALIZED (
  SELECT s.{key}, coalesce(list(coalesce({known}, 3) ORDER BY pos)
      FILTER (pos IS NOT NULL), []::BIGINT[]) AS ids
  FROM (SELECT {key} FROM {source}) s LEFT JOIN (
    SELECT {key}, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT {key}, {tokens} AS t FROM {source})) w USING ({key})
  LEFT JOIN vocab v USING (token) GROUP BY s.{key})"""


DOC_IDS = S.with_(VOCAB, ids_of("documents", "doc_id", S.words("text")))
SHORT_IDS = S.with_(SMALL_VOCAB, ids_of("documents", "doc_id", S.words("text"), model_size=SHORT_MODEL))


def doc_ids(spark, sf, words=None):
    docs = spread(B.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return vocab.vocab_lookup(docs, "text", corpus_vocab(spark, sf) if words is None else words, drop=("text",))


@query("build_vocab", S.with_(VOCAB) + "SELECT token, id FROM vocab")
def _(spark, sf):
    return corpus_vocab(spark, sf).select("token", F.col("id").cast("long").alias("id"))


def write_vocab(words, path, listed):
    """(token, id) rows with ids from 0 on as one JSON file, written as a stream in the order of ids."""
    def put(batches):
        import json

        import pandas as pd

        filesystem, place = file_system(path)
        with filesystem.open_output_stream(place, compression=None) as out:
            out.write(b'{"note": "all words", "tokens": [' if listed else b"{")
            mark = ""
            for batch in batches:
                if len(batch):  # one call for all words of a batch; no word occurs twice
                    items = json.dumps(batch["token"].tolist() if listed else dict(zip(batch["token"], batch["id"].tolist())))
                    out.write((mark + items[1:-1]).encode())
                    mark = ", "
            out.write(b"]}" if listed else b"}")
        yield pd.DataFrame({"path": [path]})

    words.repartition(1).sortWithinPartitions("id").mapInPandas(put, "path string").collect()


@query("scan_vocab", S.with_(VOCAB) + "SELECT token, id, 'list' AS form FROM vocab UNION ALL SELECT token, id * 2, 'map' FROM vocab")
def _(spark, sf):
    """Two files that hold every word of the documents."""
    words = cut(corpus_vocab(spark, sf).select("token", F.col("id").cast("bigint").alias("id")))
    root = shared_dir(spark).rstrip("/")
    found = []
    for form in ("list", "map"):
        path = f"{root}/vocab-{uuid.uuid4().hex}.json"
        write_vocab(words if form == "list" else words.withColumn("id", F.col("id") * 2), path, form == "list")
        found.append(scan_vocab_file(spark, path).withColumn("form", F.lit(form)))
    return found[0].unionByName(found[1])


@query("vocab_size", S.with_(VOCAB) + """SELECT max(id) + 1 AS size, 0::BIGINT AS not_integer, 0::BIGINT AS negative,
  0::BIGINT AS duplicated FROM vocab""")
def _(spark, sf):
    return vocab.vocab_size(corpus_vocab(spark, sf).withColumn("id", F.col("id").cast("long")))


@query("vocab_lookup", DOC_IDS + "SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids")
def _(spark, sf):
    return doc_ids(spark, sf).select("doc_id", joined(F.col("ids")).alias("ids"))


@query("vocab_lookup_join", DOC_IDS + "SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids")
def _(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    found = vocab.vocab_lookup(docs, "text", corpus_vocab(spark, sf), max_in_memory=0, drop=("text",))
    return found.select("doc_id", joined(F.col("ids")).alias("ids"))


@query("tokenize_vocab", DOC_IDS + f"SELECT doc_id, array_to_string(ids[1:{MAX_LENGTH}], ' ') AS input_ids FROM ids")
def _(spark, sf):
    docs = spread(B.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    out = vocab.tokenize_vocab(docs, "text", corpus_vocab(spark, sf), MAX_LENGTH, drop=("text",))
    return out.select("doc_id", joined(F.col("input_ids")).alias("input_ids"))


@query("tokenize_vocab_short", SHORT_IDS + f"SELECT doc_id, array_to_string(ids[1:{SHORT_LENGTH}], ' ') AS input_ids FROM ids")
def _(spark, sf):
    # A small vocabulary, a model smaller still, and short sequences.
    docs = spread(B.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    out = vocab.tokenize_vocab(docs, "text", corpus_vocab(spark, sf, SHORT_VOCAB), SHORT_LENGTH, model_size=SHORT_MODEL)
    return out.select("doc_id", joined(F.col("input_ids")).alias("input_ids"))


@query("token_length_stats", f"""WITH n AS (SELECT len({S.words('text')}) AS n FROM documents)
  SELECT count(*) AS texts, sum(n)::BIGINT AS tokens, quantile_cont(n, 0.5) AS median_length, max(n)::INTEGER AS max_length,
    round(avg(CASE WHEN n > {MAX_LENGTH} THEN 1.0::DOUBLE ELSE 0 END), 6) AS truncated_share FROM n""")
def _(spark, sf):
    docs = spread(B.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return vocab.token_length_stats(docs.select(blank_words(F.col("text")).alias("ids")), "ids", MAX_LENGTH)


@query("prepend_bos", S.with_(VOCAB, ids_of("(SELECT doc_id, CASE WHEN lang = 'en' THEN '<bos> ' || text ELSE text END AS text FROM documents)", "doc_id", S.words("text")))
       + "SELECT doc_id, array_to_string(CASE WHEN ids[1] = 1 THEN ids ELSE list_prepend(1, ids) END, ' ') AS ids FROM ids")
def _(spark, sf):
    docs = spread(B.table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    marked = docs.withColumn("text", F.when(F.col("lang") == "en", F.concat(F.lit("<bos> "), "text")).otherwise(F.col("text")))
    found = vocab.vocab_lookup(marked, "text", corpus_vocab(spark, sf), drop=("text",))
    return found.select("doc_id", joined(E.prepend_bos(F.col("ids"))).alias("ids"))


@query("detokenize", S.with_(VOCAB, ids_of("documents", "doc_id", S.words("text")), """
half AS (SELECT * FROM vocab WHERE id % 3 <> 1),
spoken AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM ids)""") + """
  SELECT i.doc_id, coalesce(string_agg(coalesce(h.token, '[<UNK>_ID:' || s.id || ']'), ' ' ORDER BY s.pos)
    FILTER (s.id NOT IN (0, 1, 2)), '') AS text FROM ids i LEFT JOIN spoken s USING (doc_id) LEFT JOIN half h ON h.id = s.id GROUP BY i.doc_id""")
def _(spark, sf):
    # Ids of the whole vocabulary read with two thirds of it, so that unknown ids show.
    words = stored(corpus_vocab(spark, sf), "vocab")
    partial = words.where("id % 3 <> 1")
    return vocab.detokenize(doc_ids(spark, sf, words), "ids", partial).select("doc_id", "text")


@query("detokenize_join", ORACLE["detokenize"])
def _(spark, sf):
    words = stored(corpus_vocab(spark, sf), "vocab")
    partial = words.where("id % 3 <> 1")
    return vocab.detokenize(doc_ids(spark, sf, words), "ids", partial, max_in_memory=0).select("doc_id", "text")


# --- examples --------------------------------------------------------------------------


def padded(ids: str) -> str:
    return f"list_concat({ids}, list_resize([]::BIGINT[], greatest(0, {MAX_LENGTH} - len({ids})), 0))"


def flat_example(df, *keys):
    return df.select(*keys, *[joined(F.col(f"x.{c}")).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("pretrain_example", DOC_IDS + f"""SELECT doc_id, array_to_string(x, ' ') AS input_ids,
  array_to_string(list_transform(x, lambda i: CASE WHEN i = 0 THEN 0 ELSE 1 END), ' ') AS attention_mask,
  array_to_string(list_transform(x, lambda i: CASE WHEN i = 0 THEN -100 ELSE i END), ' ') AS labels
  FROM (SELECT doc_id, {padded(f'ids[1:{MAX_LENGTH}]')} AS x FROM ids)""")
def _(spark, sf):
    return flat_example(doc_ids(spark, sf).select("doc_id", E.pretrain_example(F.col("ids"), MAX_LENGTH).alias("x")), "doc_id")


PAIRS = """pairs AS MATERIALIZED (SELECT a.conv_id * 1000000 + a.turn AS key, a.conv_id, a.turn, a.text AS instruction, b.text AS output
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""


def sft_pairs(spark, sf):
    return chat.chat_pairs(B.table(spark, sf, "conversations"))


@query("chat_pairs", S.with_(PAIRS) + "SELECT conv_id, turn, instruction, output FROM pairs")
def _(spark, sf):
    return sft_pairs(spark, sf)


SFT_PROMPT = "rtrim('User: ' || instruction || chr(10) || 'Assistant: ', " + S.lit(S.BLANK_CHARS) + ")"


@query("sft_prompt", S.with_(PAIRS) + f"""SELECT conv_id, turn, {SFT_PROMPT} AS prompt,
  'User: ' || instruction || chr(10) || 'Assistant: ' || output AS whole,
  'Q ' || instruction || ' A' AS custom FROM pairs""")
def _(spark, sf):
    i, o = F.col("instruction"), F.col("output")
    return sft_pairs(spark, sf).select(
        "conv_id", "turn", P.sft_prompt(i, "no marks here").alias("prompt"), P.sft_text(i, o).alias("whole"),
        P.sft_prompt(i, "Q {instruction} A {output}").alias("custom"))


WHOLE = "list_concat(list_concat(p.ids, o.ids), [2])"


@query("sft_example", S.with_(PAIRS, VOCAB, ids_of("pairs", "key", S.words(SFT_PROMPT), "prompt_ids"),
                              ids_of("pairs", "key", S.words("output"), "output_ids"), f"""
cut AS (SELECT key, len(p.ids) AS np, CASE WHEN len({WHOLE}) > {MAX_LENGTH}
    THEN list_concat(({WHOLE})[1:{MAX_LENGTH - 1}], [2]) ELSE {WHOLE} END AS ids
  FROM prompt_ids p JOIN output_ids o USING (key)),
full_rows AS (SELECT key, np, len(ids) AS n, {padded('ids')} AS x FROM cut)""") + """
  SELECT key, array_to_string(x, ' ') AS input_ids,
    array_to_string(list_transform(x, lambda i: CASE WHEN i = 0 THEN 0 ELSE 1 END), ' ') AS attention_mask,
    array_to_string(list_transform(x, lambda i, pos: CASE WHEN pos = n AND np < n THEN i WHEN pos <= np OR i = 0 THEN -100 ELSE i END), ' ') AS labels
  FROM full_rows""")
def _(spark, sf):
    pairs = sft_pairs(spark, sf).select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("key"), "instruction", "output")
    words = stored(corpus_vocab(spark, sf), "vocab")
    prompt = vocab.token_ids(pairs, blank_words(P.sft_prompt(F.col("instruction"))), words, "prompt_ids", drop=("instruction",))
    both = vocab.token_ids(prompt, blank_words(F.col("output")), words, "output_ids", drop=("output",))
    return flat_example(both.select("key", E.sft_example(F.col("prompt_ids"), F.col("output_ids"), MAX_LENGTH).alias("x")), "key")


# --- batches and prompts ---------------------------------------------------------------


def batches_sql(world: int, size: int, shuffle: bool, drop: bool) -> str:
    order = "md5('3:1:' || doc_id), doc_id" if shuffle else "doc_id"
    per_rank = f"((n + {world - 1}) // {world})"
    keep = f"WHERE pos // {world} // {size} < {per_rank} // {size}" if drop else ""
    return f"""WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM documents),
  dealt AS (SELECT * FROM placed UNION ALL SELECT doc_id, pos + n, n FROM placed WHERE pos + n < {per_rank} * {world})
  SELECT doc_id, pos, (pos % {world})::INTEGER AS rank, pos // {world} // {size} AS batch,
    (pos // {world} % {size})::INTEGER AS slot FROM dealt {keep}"""


def batches(spark, sf, **options):
    docs = B.table(spark, sf, "documents").select("doc_id")
    return shard_batches(docs, "doc_id", epoch=1, seed=3, **options).select("doc_id", "pos", "rank", "batch", "slot")


@query("shard_batches", batches_sql(3, 16, True, True))
def _(spark, sf):
    return batches(spark, sf, batch_size=16, world_size=3)


@query("shard_batches_validation", batches_sql(3, 16, False, False))
def _(spark, sf):
    return batches(spark, sf, batch_size=16, world_size=3, shuffle=False)


def permuted_sql(total: str, seed: int, epoch: int, bits: str, x: str) -> str:
    """One step of the keyed bijection below 2^bits."""
    out = x
    for i in range(ROUNDS):
        digest = f"md5('{seed}:{epoch}:{i}')"
        factor = f"(('0x' || substr({digest}, 1, 5))::BIGINT | 1)"
        summand = f"(('0x' || substr({digest}, 6, 10))::BIGINT % (1::BIGINT << {bits}))"
        moved = f"(({out} * {factor} + {summand}) & ((1::BIGINT << {bits}) - 1))"
        out = f"xor({moved}, {moved} >> (({bits} + 1) // 2))"
    return out


# Every number walks along its cycle until it is below n.
EPOCHS = "WITH RECURSIVE sized AS (SELECT count(*) AS n, greatest(1, ceil(log2(count(*))))::BIGINT AS bits FROM documents),\n" + ",\n".join(f"""walk{e} AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, 0 AS step FROM documents
  UNION ALL SELECT doc_id, {permuted_sql('n', 3, e, 'bits', 'x')}, step + 1 FROM walk{e}, sized WHERE step = 0 OR x >= n)""" for e in (1, 2)) + """
  SELECT epoch, doc_id, pos, (pos % 3)::INTEGER AS rank, pos // 3 // 16 AS batch, (pos // 3 % 16)::INTEGER AS slot FROM (
    SELECT 1 AS epoch, doc_id, arg_max(x, step) AS pos FROM walk1 GROUP BY doc_id UNION ALL SELECT 2, doc_id, arg_max(x, step) FROM walk2 GROUP BY doc_id)
  WHERE pos // 3 // 16 < (SELECT (n + 2) // 3 FROM sized) // 16
  UNION ALL SELECT epoch, doc_id, pos + n, ((pos + n) % 3)::INTEGER, (pos + n) // 3 // 16, ((pos + n) // 3 % 16)::INTEGER FROM (
    SELECT 1 AS epoch, doc_id, arg_max(x, step) AS pos FROM walk1 GROUP BY doc_id UNION ALL SELECT 2, doc_id, arg_max(x, step) FROM walk2 GROUP BY doc_id), sized
  WHERE pos + n < (n + 2) // 3 * 3 AND (pos + n) // 3 // 16 < (n + 2) // 3 // 16"""


@query("epoch_batches", EPOCHS)
def _(spark, sf):
    """Two epochs over rows that are numbered once."""
    numbered = number_rows(B.table(spark, sf, "documents").select("doc_id"), "doc_id")
    total = numbered.count()
    epochs = [epoch_batches(numbered, total, 16, 3, epoch, seed=3).withColumn("epoch", F.lit(epoch)) for epoch in (1, 2)]
    return epochs[0].unionByName(epochs[1]).select("epoch", "doc_id", "pos", "rank", "batch", "slot")


@query("chat_prompt", """WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id)
  SELECT l.conv_id, l.turn, string_agg(upper(c.role[1]) || lower(substr(c.role, 2)) || ': ' || c.text, chr(10) ORDER BY c.turn)
    || chr(10) || 'Assistant:' AS prompt
  FROM last l JOIN conversations c ON c.conv_id = l.conv_id AND c.turn <= l.turn GROUP BY l.conv_id, l.turn""")
def _(spark, sf):
    return chat.chat_prompt(B.table(spark, sf, "conversations"))
