"""Files in and out, and the corpus stages over generated archives."""
import gzip
import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators.langid import filter_language, lang_identify, train_language_model
from textloom.plans import corpus
from textloom.plans.ledger import committed, run_once
from textloom.sources.vocab_file import scan_vocab_file, vocab_rows
from textloom.sources import images, jsonl, manifest, sinks, subword, warc


def record(kind, uri, block, length=None):
    mime = f"application/http; msgtype={kind}"
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {mime}\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def response(status, body, headers=""):
    return f"HTTP/1.1 {status} OK\r\n{headers}\r\n".encode() + body


RECORDS = [
    record("warcinfo", "", b"software: x\r\n"),
    record("request", "http://a/1", b"GET / HTTP/1.1\r\n\r\n"),
    record("response", "http://a/1", response(200, b"<p>one</p>")),
    record("response", "http://a/2", response(404, b"gone")),
    record("response", "http://a/3", response(200, b"")),
    record("response", "http://a/4", b"no status line"),
    record("response", "http://a/5", response(200, b"4\r\nWiki\r\n2;x\r\n!!\r\n0\r\n\r\n", "Transfer-Encoding: chunked\r\n")),
    record("response", "http://a/6", response(200, gzip.compress(b"packed"), "Content-Encoding: gzip\r\n")),
]
WANT = [("response", "200", b"<p>one</p>"), ("response", "404", b"gone"), ("response", "200", b""),
        ("response", None, None), ("response", "200", b"Wiki!!"), ("response", "200", b"packed")]


def read(data):
    return [(k, s, b) for k, _, s, b, _ in warc.read_records(io.BytesIO(data)) if k == "response"]


def test_plain_and_gzip_records():
    assert read(b"".join(RECORDS)) == WANT
    assert read(b"".join(gzip.compress(r) for r in RECORDS)) == WANT


def test_damaged_member_is_skipped():
    members = [bytearray(gzip.compress(r)) for r in RECORDS]
    members[3][12:20] = b"\xff" * 8
    got = read(b"".join(bytes(m) for m in members))
    assert got[0] == WANT[0] and got[-2:] == WANT[-2:]


def test_cut_record_is_reported():
    data = b"".join(RECORDS[:2]) + record("response", "http://z", response(200, b"half"), 10_000)
    last = list(warc.read_records(io.BytesIO(data)))[-1]
    assert last[3] is None and "cut off" in last[4]


def test_small_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    assert read(b"".join(gzip.compress(r) for r in RECORDS)) == WANT


@pytest.mark.parametrize("split", [warc.SPLIT_BYTES, 150, 1])
def test_archive_source(spark, tmp_path, split):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS))
    (tmp_path / "sub" / "b.warc").write_bytes(b"".join(RECORDS))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(RECORDS)))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.scan_web_archive(spark, str(tmp_path), split_bytes=split).collect()
    assert len(rows) == 24 and sum(r.error is not None for r in rows) == 3
    for name in ("a.warc.gz", "sub/b.warc", "c.warc.gz"):
        mine = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: (r.offset, r.rec_no))
        assert [(r.rec_type, r.http_status, None if r.body is None else bytes(r.body)) for r in mine if r.rec_type == "response"] == WANT


def stored_member(data):
    """A gzip member that holds the data as it is."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@pytest.mark.parametrize("split", [40, 97, 100_000])
def test_archives_inside_bodies_are_no_records(spark, tmp_path, split):
    inner = b"".join(gzip.compress(r) for r in RECORDS)
    outer = [record("response", f"http://o/{i}", response(200, inner)) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(stored_member, outer)))
    plain = [record("response", f"http://p/{i}", response(200, b"\n" + b"".join(RECORDS))) for i in range(3)]
    (tmp_path / "b.warc").write_bytes(b"".join(plain))
    rows = warc.scan_web_archive(spark, str(tmp_path), split_bytes=split).collect()
    assert sorted(r.uri for r in rows) == [f"http://{f}/{i}" for f in "op" for i in range(3)]
    assert {bytes(r.body) for r in rows} == {inner, b"\n" + b"".join(RECORDS)}


def test_damaged_members_and_cut_files(spark, tmp_path):
    members = [bytearray(gzip.compress(r)) for r in RECORDS]
    members[3][12:20] = b"\xff" * 8
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(bytes, members)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(bytes, members[4:]))[:-5])
    got = warc.scan_web_archive(spark, str(tmp_path), "rec_type = 'response'").collect()
    assert sorted(r.uri for r in got) == sorted([f"http://a/{i}" for i in (1, 3, 4, 5, 6)] + [f"http://a/{i}" for i in (3, 4, 5)])


def test_one_large_archive_fills_several_tasks_and_filters_run_on_the_index(spark, tmp_path):
    records = [record(kind, f"http://x/{i}", response(200 + i % 2, b"%d " % i * 300)) for i in range(400) for kind in ("request", "response")]
    (tmp_path / "big.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    index = warc.archive_index(spark, str(tmp_path), 8192)
    assert index.count() == 800 and index.inputFiles()
    rows = warc.scan_web_archive(spark, str(tmp_path), "rec_type = 'response' and http_status = '200'", index=index, split_bytes=8192)
    plan = rows._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(rec_type), IsNotNull(http_status), EqualTo(rec_type,response), EqualTo(http_status,200)]" in plan
    found = rows.select("uri", "body", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 200 and len({r.task for r in found}) > 3
    assert {(r.uri, bytes(r.body)) for r in found} == {(f"http://x/{i}", b"%d " % i * 300) for i in range(0, 400, 2)}
    heads = warc.scan_web_archive(spark, str(tmp_path), "http_status = '201'", bodies=False, index=index)
    assert "body" not in heads.columns and heads.count() == 200


def test_binary(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\x00\x01")
    assert [(r.length, bytes(r.content)) for r in warc.scan_binary(spark, str(tmp_path)).collect()] == [(2, b"\x00\x01")]


# --- manifest and fetch


def test_manifest_and_fetch(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "d").mkdir(parents=True)
    target.mkdir()
    for i in range(3):
        (source / "d" / f"f{i}").write_bytes(b"x" * i)
    paths = ["d/f2 ", "d/f0", "d/none", "d/f1"]
    (tmp_path / "paths.gz").write_bytes(gzip.compress("\n".join(paths).encode()))
    listed = manifest.scan_manifest(spark, str(tmp_path / "paths.gz"))
    assert [r.path for r in listed.orderBy("pos").collect()] == [p.strip() for p in paths]
    assert [r.path for r in manifest.manifest_head(listed, 2).collect()] == ["d/f2", "d/f0"]
    assert manifest.manifest_head(listed, 0).count() == 4
    for _ in range(2):  # a repeated fetch writes the same files
        report = manifest.fetch_report(listed, f"file://{target}", f"file://{source}/", 3).collect()
        assert {(r.path, r.status, r.bytes) for r in report} == {
            ("d/f2", "SUCCESS", 2), ("d/f0", "SUCCESS", 0), ("d/f1", "SUCCESS", 1), ("d/none", "FAILURE", None)}
    assert sorted(p.name for p in target.iterdir() if not p.name.startswith(".")) == ["d_f0", "d_f1", "d_f2"]


# --- JSON Lines

LINES = ['{"text": "a  b"}', '{"text": null}', '{"text": ["x", "y z"]}', '{"text": [4, 5]}', '{"label": "q"}', "{broken",
         '{"text": "a"} {"text": "b"}', '{"text": "a"}}', '["text"]', "", ' {"text": "é", "label": "l", "image": "i.png"} ', "7", '{"text": "a"}] 1']


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, value string")


def test_pretrain_lines(spark):
    rows = {r.i: r for r in jsonl.scan_jsonl_pretrain(lines(spark, LINES), "value", "i").collect()}
    assert sorted(rows) == [0, 1, 2, 3, 10]
    assert rows[0].text == "a  b" and rows[0].tokens == ["a", "b"]
    assert rows[1].text is None and rows[1].tokens is None
    assert rows[2].text is None and rows[2].tokens == ["x", "y z"] and rows[2].ids == [None, None]
    assert rows[3].ids == [4, 5] and rows[3].tokens == [None, None] and rows[0].ids is None
    assert (rows[10].text, rows[10].label, rows[10].image) == ("é", "l", "i.png")
    assert jsonl.line_rejects(lines(spark, LINES), ["text"]).first().asDict() == {"lines": 13, "bad_json": 7, "missing_field": 1}


def test_values_keep_their_kind(spark):
    texts = ['{"text": 5}', '{"text": [1, "a", 2.5, null]}', '{"text": {"a": 1}}', '{"text": []}']
    rows = jsonl.scan_jsonl_pretrain(lines(spark, texts), "value", "i").orderBy("i").collect()
    assert [(r.text, r.tokens, r.ids) for r in rows] == [
        (None, None, None), (None, [None, "a", "2.5", None], [1, None, None, None]), (None, None, None), (None, [], [])]


def test_repeated_keys_and_numbers_outside_the_standard(spark):
    """Like a reader that keeps the last of repeated keys and knows NaN and infinities."""
    texts = ['{"text": "a", "text": "b"}', '{"text": NaN, "label": "l"}', '{"text": ["a", NaN, 3, -Infinity]}', '{"m": {"a": 1, "a": 2}, "text": "x"}',
             '{"text": "x", "text": {"a": 1, "a": 2}}', '{"text": {"a": 1, "a": 2}, "text": "x"}', '{"text": null, "text": null}',
             '{"text": "a", "v": INF}', '{"text": "a", "text": "b"} {"text": "c"}', '{"text": "a", "text": "b"},{"text": "c"}',
             '{"text": "a", "text": "b"}] [1', '{"label": "a", "label": "b"}', '{"text": "a", "v": NaN']
    rows = {r.i: (r.text, r.tokens, r.ids, r.label) for r in jsonl.scan_jsonl_pretrain(lines(spark, texts), "value", "i").collect()}
    nothing = (None, None, None, None)
    assert rows == {
        0: ("b", ["b"], None, None), 1: (None, None, None, "l"), 2: (None, ["a", "NaN", None, "-Infinity"], [None, None, 3, None], None),
        3: ("x", ["x"], None, None), 4: nothing, 5: ("x", ["x"], None, None), 6: nothing}
    assert jsonl.line_rejects(lines(spark, texts), ["text"]).first().asDict() == {"lines": 13, "bad_json": 5, "missing_field": 1}


def test_sft_and_seed_lines(spark):
    texts = ['{"instruction": "i", "output": "o"}', '{"instruction": "i"}', '{"instruction": "", "output": null}']
    assert [tuple(r) for r in jsonl.scan_jsonl_sft(lines(spark, texts)).collect()] == [("i", "o"), ("", None)]
    texts = ['{"type": "induction", "task": "t"}', '{"type": "other", "task": "t"}', '{"type": "deduction"}', "x"]
    assert [tuple(r) for r in jsonl.scan_seed_tasks(lines(spark, texts)).collect()] == [("induction", "t")]


# --- vocabulary files

@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_vocabulary_in_pieces(chunk):
    def rows(text):
        return [(t, i) for _, _, t, i in vocab_rows(io.BytesIO(text.encode()), chunk) if t is not None]

    assert rows('{"tokens": ["a", "é\\n\\u00e9", "日本", "a"] , "n": 12345}') == [("a", 0), ("é\né", 1), ("日本", 2), ("a", 3), ("n", 12345)]
    assert rows(' { "a" : 0 , "b" :12,"c": "5", "d": 1.5, "e": [1, {"x": 2}], "f": true} ') == [
        ("a", 0), ("b", 12), ("c", None), ("d", None), ("e", None), ("f", None)]
    assert rows("{}") == rows('{"tokens": []}') == []
    for bad in ('{"a": 1', '["a"]', '{"a": 1} x', '{"tokens": ["a"', "", '{"a" 1}'):
        with pytest.raises(ValueError):
            rows(bad)


@pytest.mark.parametrize("chunk", [5, 64, 1 << 20])
def test_vocabulary_items_are_parsed_together(chunk, monkeypatch):
    from textloom.sources import vocab_file

    def rows(text):
        return list(vocab_rows(io.BytesIO(text.encode()), chunk))

    texts = [r'{"a": 1, "b": [1, {"c": 2, "tokens": [3, 4]}], "a": 7, "d,e": 9223372036854775808, "\",": -5, "z": {}}',
             r'{"n": 1, "tokens": ["a,b", "c\",", {"x": [1, 2]}, 5, "a", null], "m": 2}', '{"tokens": 5, "a": 1, "tokens": ["x"], "b": 2}',
             json.dumps({f"w,{i}": i for i in range(300)}), json.dumps({"tokens": [f"é'{i}" for i in range(300)]})]
    together = [rows(t) for t in texts]
    calls = []
    value = vocab_file._Pieces.value
    monkeypatch.setattr(vocab_file._Pieces, "value", lambda self: calls.append(1) or value(self))
    rows(texts[3])
    assert chunk < 1 << 20 or len(calls) <= 4
    monkeypatch.setattr(vocab_file, "MANY_TRIES", 0)
    assert together == [rows(t) for t in texts]
    for bad in ('{,"a": 1}', '{"a": 1,}', '{"tokens": [,"a"]}', '{"tokens": ["a",,"b"]}', '{"a": 1,, "b": 2}'):
        monkeypatch.undo()
        with pytest.raises(ValueError):
            rows(bad)


def test_vocabulary_files(spark, tmp_path):
    def scan(text):
        (tmp_path / "v.json").write_text(text)
        return {r.token: r.id for r in scan_vocab_file(spark, str(tmp_path / "v.json")).collect()}

    assert scan('{"x": 9, "tokens": ["a", "b", "a"], "y": 3}') == {"a": 2, "b": 1}
    assert scan('{"a": 1, "b": 7, "a": 3, "tokens": 5}') == {"a": 3, "b": 7, "tokens": 5}
    assert scan('{"tokens": [], "a": 1}') == {} == scan("{}")
    many = {f"w{i}": i for i in range(70_000)}
    assert scan(json.dumps(many)) == many


# --- images


def png(pixels):
    height, width, _ = pixels.shape
    raw = b"".join(b"\x00" + pixels[y].tobytes() for y in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_resize():
    flat = np.full((5, 9, 3), 77, np.uint8)
    assert (images.resize(flat, 4) == 77).all()
    ramp = np.repeat(np.arange(0, 256, 32, dtype=np.uint8)[None, :, None], 8, axis=0).repeat(3, axis=2)
    half = images.resize(ramp, 4)
    assert half.shape == (4, 4, 3) and (np.diff(half[0, :, 0].astype(int)) > 0).all()
    assert (images.resize(ramp, 8) == ramp).all()


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (4, 4, 3), dtype=np.uint8)
    (tmp_path / "ok.png").write_bytes(png(pixels))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    scanned = images.scan_images(spark, str(tmp_path), 4)
    df = spark.createDataFrame([(1, "ok.png"), (2, "bad.png"), (3, "none.png"), (4, None)], "i int, image string")
    rows = {r.i: r.pixel_values for r in images.image_join(df, scanned, str(tmp_path), size=4).collect()}
    mean, std = np.array(images.IMAGE_MEAN, np.float32), np.array(images.IMAGE_STD, np.float32)
    want = ((pixels.astype(np.float32) / 255 - mean) / std).transpose(2, 0, 1).ravel()
    assert np.allclose(rows[1], want, atol=1e-6)
    assert rows[2] == rows[3] == [0.0] * 48 and rows[4] is None


# --- subword tokenizer


@pytest.fixture(scope="module")
def tokenizer(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    words = {w: i for i, w in enumerate(["<s>", "</s>", "<unk>", "User", ":", "Assistant", "hi", "there", "yes", "no"])}
    built = Tokenizer(models.WordLevel(words, unk_token="<unk>"))
    built.pre_tokenizer = pre_tokenizers.Whitespace()
    built.add_special_tokens(["<s>", "</s>"])
    built.post_processor = processors.TemplateProcessing(single="<s> $A", special_tokens=[("<s>", 0)])
    path = tmp_path_factory.mktemp("tok") / "tokenizer.json"
    built.save(str(path))
    return str(path)


def test_tokenize_subword(spark, tokenizer):
    df = spark.createDataFrame([(1, "hi there x"), (2, ""), (3, None), (4, "yes " * 9)], "i int, t string")
    got = {r.i: r.input_ids for r in subword.tokenize_subword(df, "t", tokenizer, 5).collect()}
    assert got == {1: [0, 6, 7, 2], 2: [0], 3: None, 4: [0, 8, 8, 8, 8]}


def test_sft_example_subword(spark, tokenizer):
    df = spark.createDataFrame([("User: hi Assistant:", "User: hi Assistant: yes")], "p string, t string")
    row = subword.sft_example_hf(df, "p", "t", tokenizer, 10, "</s>", bos_token="<s>").first()
    assert row.input_ids == [0, 3, 4, 6, 5, 4, 8, 1, 1, 1]  # the end mark pads
    assert row.attention_mask == [1] * 7 + [0] * 3
    assert row.labels == [-100] * 6 + [8, 1, -100, -100]
    cut = subword.sft_example_hf(df, "p", "t", tokenizer, 4, "</s>", bos_token="<s>").first()
    assert cut.input_ids == [0, 3, 4, 6] and cut.labels == [-100] * 4


# --- sinks and stages


def test_token_sink_formats(spark, tmp_path):
    df = spark.createDataFrame([([1, 2],)], "input_ids array<int>")
    with pytest.warns(UserWarning):
        sinks.sink_tokens(df, str(tmp_path / "t"), "Arrow")
    assert spark.read.parquet(str(tmp_path / "t")).first().input_ids == [1, 2]
    with pytest.raises(ValueError):
        sinks.sink_tokens(df, str(tmp_path / "u"), "csv")


def test_resumed_metrics(spark, tmp_path):
    df = spark.createDataFrame([("tasks_valid", 3.0)], "metric string, value double")
    sinks.sink_run_metrics(df, str(tmp_path / "m"))
    assert [tuple(r) for r in sinks.load_run_metrics(spark, str(tmp_path / "m")).collect()] == [("tasks_valid", 3.0)]


def test_languages(spark):
    texts = [(i, "the cat and the dog went to the house", "en") for i in range(5)]
    texts += [(i + 10, "der hund und die katze gehen nach hause", "de") for i in range(5)]
    df = spark.createDataFrame(texts, "doc_id int, text string, lang string")
    model = train_language_model(df)
    new = spark.createDataFrame([(1, "the house"), (2, "die katze"), (3, ""), (4, None)], "doc_id int, text string")
    small = {r.doc_id: r.predicted for r in lang_identify(new, model).collect()}
    assert small[1] == "en" and small[2] == "de" and len(small) == 4
    from textloom.operators import langid
    scores, languages = langid.lang_scores(new, model, hot_rows=1)
    assert {r.doc_id: r.predicted for r in langid.top1_language(scores, languages).collect()} == small
    assert {r.doc_id: r.predicted for r in lang_identify(new, model, max_cells=1).collect()} == small
    assert filter_language(df, F.col("lang"), []).count() == 10
    assert filter_language(df, F.col("lang"), ["de"]).count() == 5


@pytest.fixture
def corpus_config(tmp_path):
    texts = ["hi there yes " * 30, "no there hi " * 30, "hi there yes " * 30, "tiny"]
    pages = [f"<html><nav>menu</nav><p>{t}</p></html>".encode() for t in texts]
    source = tmp_path / "web" / "seg"
    source.mkdir(parents=True)
    archive = [gzip.compress(record("response", f"http://p/{i}", response(200 if i < 4 else 500, p))) for i, p in enumerate(pages + pages[:1])]
    (source / "one.warc.gz").write_bytes(b"".join(archive))
    (tmp_path / "paths.gz").write_bytes(gzip.compress(b"seg/one.warc.gz\nseg/two.warc.gz\n"))
    return corpus.CorpusConfig(
        corpus.DownloadConfig(str(tmp_path / "paths.gz"), f"file://{tmp_path}/web/", 10, f"file://{tmp_path}/raw", 2),
        corpus.CleanConfig(str(tmp_path / "raw"), str(tmp_path / "clean"), language_whitelist=[]),
        corpus.DedupConfig(str(tmp_path / "clean"), str(tmp_path / "unique")),
        corpus.TokenizeConfig(str(tmp_path / "unique"), str(tmp_path / "tokens"), max_length=16),
    )


def test_stages(spark, tmp_path, corpus_config):
    cfg = corpus_config
    assert corpus.run_corpus(spark, cfg) == list(corpus.STAGES)
    assert committed(spark, str(tmp_path / "raw"))["counts"] == {"SUCCESS": 1, "FAILURE": 1}
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 3
    tokens = spark.read.parquet(str(tmp_path / "tokens")).collect()
    assert len(tokens) == 2 and all(len(r.input_ids) == 16 for r in tokens)
    assert {tuple(r.input_ids[:3]) for r in tokens} == {(4, 5, 7), (6, 5, 4)}
    assert corpus.run_corpus(spark, cfg) == []
    cfg.stages = ("tokenize", "deduplicate")  # run in their fixed order
    cfg.deduplicate.unit = "line"
    assert corpus.run_corpus(spark, cfg) == ["deduplicate", "tokenize"]
    assert spark.read.parquet(str(tmp_path / "unique")).count() == 2
    cfg.stages = ("publish",)
    with pytest.raises(ValueError):
        corpus.run_corpus(spark, cfg)
    cfg.stages, cfg.deduplicate.input_dir = ("deduplicate",), str(tmp_path / "missing")
    with pytest.raises(Exception):
        corpus.run_corpus(spark, cfg)


def test_a_killed_run_goes_on_after_its_last_finished_stage(spark, tmp_path, corpus_config, monkeypatch):
    cfg, whole = corpus_config, corpus.sink_documents

    def half(df, path):
        whole(df.limit(1), path)
        raise KeyboardInterrupt

    cfg.stages = ("download", "clean")
    assert corpus.run_corpus(spark, cfg) == ["download", "clean"]
    cfg.stages = corpus.STAGES
    monkeypatch.setattr(corpus, "sink_documents", half)
    with pytest.raises(KeyboardInterrupt):
        corpus.run_corpus(spark, cfg)
    # The half-written stage left no output, and the finished ones are as they were.
    assert not (tmp_path / "unique").exists() and committed(spark, str(tmp_path / "clean"))
    monkeypatch.setattr(corpus, "sink_documents", whole)
    assert corpus.run_corpus(spark, cfg) == ["deduplicate", "tokenize"]
    assert spark.read.parquet(str(tmp_path / "unique")).count() == 2
    # A new input file starts the run over from the stage that reads it.
    (tmp_path / "raw" / "more.warc.gz").write_bytes(gzip.compress(record("response", "http://q", response(200, b"<p>" + b"new words here " * 30))))
    cfg.stages = ("clean", "deduplicate", "tokenize")
    assert corpus.run_corpus(spark, cfg) == ["clean", "deduplicate", "tokenize"]
    assert spark.read.parquet(str(tmp_path / "tokens")).count() == 3


def test_folders_of_others_are_not_replaced(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "precious").write_text("x")
    with pytest.raises(FileExistsError):
        run_once(spark, "s", {}, [], str(tmp_path / "out"), lambda folder: None)
    assert (tmp_path / "out" / "precious").read_text() == "x"


def test_file_uris():
    from textloom.sources.files import file_system

    for uri in ("/a/b", "file:/a/b", "file:///a/b"):
        system, path = file_system(uri)
        assert system.type_name == "local" and path == "/a/b"
