"""The corpus stages in fixed order: download, clean, deduplicate, tokenize."""
from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.html import decode_body
from textloom.operators.cleaning import MAX_LENGTH, MIN_LENGTH, clean_documents
from textloom.operators.dedup import dedup_documents
from textloom.operators.graph import MAX_ROUNDS
from textloom.operators.storage import cut
from textloom.operators.vocab import build_vocab, tokenize_vocab
from textloom.plans.ledger import run_once
from textloom.sources.jsonl import scan_text_lines
from textloom.sources.manifest import BASE_URL, fetch_report, manifest_head, scan_manifest
from textloom.sources.sinks import sink_documents, sink_tokens
from textloom.sources.warc import scan_web_archive

STAGES = ("download", "clean", "deduplicate", "tokenize")


@dataclass
class DownloadConfig:
    manifest: str = ""
    base_url: str = BASE_URL
    num_files: int = 1000
    output_dir: str = "data/raw"
    num_partitions: int = 200


@dataclass
class CleanConfig:
    input_dir: str = "data/raw"
    output_dir: str = "data/clean"
    min_text_length: int = MIN_LENGTH
    max_text_length: int = MAX_LENGTH
    language_model: str | None = None  # Parquet table (lang, gram, logp)
    language_whitelist: list[str] = field(default_factory=lambda: ["en"])


@dataclass
class DedupConfig:
    input_dir: str = "data/clean"
    output_dir: str = "data/unique"
    threshold: float = 0.8
    num_perm: int = 128
    bands: int | None = None  # by default what fits the threshold best
    verify: bool = False
    unit: str = "document"  # or "line": every line of a text is a document of its own
    max_rounds: int = MAX_ROUNDS


@dataclass
class TokenizeConfig:
    input_dir: str = "data/unique"
    output_dir: str = "data/tokens"
    vocabulary: str | None = None  # Parquet table (token, id); by default the words of the input
    vocabulary_size: int | None = None
    max_length: int = 2048
    output_format: str = "parquet"


@dataclass
class CorpusConfig:
    download: DownloadConfig = field(default_factory=DownloadConfig)
    clean: CleanConfig = field(default_factory=CleanConfig)
    deduplicate: DedupConfig = field(default_factory=DedupConfig)
    tokenize: TokenizeConfig = field(default_factory=TokenizeConfig)
    stages: tuple[str, ...] = STAGES


# Every stage writes below ``output``, by default the folder its settings name.


def run_download(spark: SparkSession, cfg: DownloadConfig, output: str | None = None) -> dict[str, int]:
    """Fetch the listed files; returns the count per status."""
    wanted = manifest_head(scan_manifest(spark, cfg.manifest), cfg.num_files)
    report = fetch_report(wanted, output or cfg.output_dir, cfg.base_url, cfg.num_partitions)
    counts = {r.status: r.n for r in report.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if counts and "SUCCESS" not in counts:
        raise OSError(f"none of {sum(counts.values())} files could be fetched from {cfg.base_url}")
    return counts


def run_clean(spark: SparkSession, cfg: CleanConfig, output: str | None = None) -> None:
    found = scan_web_archive(spark, cfg.input_dir, "error is null and rec_type = 'response' and http_status = '200'")
    records = found.where("error is null").select(
        F.concat_ws("#", "path", F.lpad(F.col("offset").cast("string"), 16, "0"), F.lpad(F.col("rec_no").cast("string"), 6, "0")).alias("doc_id"),
        "rec_type", "http_status",
        decode_body(F.col("body")).alias("body"),
    )
    model = spark.read.parquet(cfg.language_model) if cfg.language_model else None
    sink_documents(clean_documents(
        records, "doc_id", "body", model, cfg.language_whitelist,
        cfg.min_text_length, cfg.max_text_length,
    ), output or cfg.output_dir)


def as_lines(documents: DataFrame) -> DataFrame:
    """Every line as a document; ids follow document and line number."""
    return scan_text_lines(documents, "text", "doc_id").select(
        F.concat_ws("#", "doc_id", F.lpad(F.col("line_no").cast("string"), 10, "0")).alias("doc_id"),
        F.col("value").alias("text"),
    )


def run_deduplicate(spark: SparkSession, cfg: DedupConfig, output: str | None = None) -> None:
    documents = spark.read.parquet(cfg.input_dir)
    if cfg.unit == "line":
        documents = as_lines(documents)
    elif cfg.unit != "document":
        raise ValueError(f"unknown unit {cfg.unit!r}: use document or line")
    sink_documents(dedup_documents(
        documents, num_perm=cfg.num_perm, threshold=cfg.threshold, bands=cfg.bands,
        verify=cfg.verify, max_rounds=cfg.max_rounds,
    ), output or cfg.output_dir)


def run_tokenize(spark: SparkSession, cfg: TokenizeConfig, output: str | None = None) -> None:
    documents = spark.read.parquet(cfg.input_dir)
    words = spark.read.parquet(cfg.vocabulary) if cfg.vocabulary else cut(
        build_vocab(documents, "text", cfg.vocabulary_size))
    tokens = tokenize_vocab(documents, "text", words, cfg.max_length)
    sink_tokens(tokens.select("doc_id", "input_ids"), output or cfg.output_dir, cfg.output_format)


def _inputs(stage: str, cfg) -> list[str]:
    """Files whose listing belongs to a stage's fingerprint."""
    more = {"download": ["manifest"], "clean": ["input_dir", "language_model"], "tokenize": ["input_dir", "vocabulary"]}
    return [path for name in more.get(stage, ["input_dir"]) if (path := getattr(cfg, name))]


def run_corpus(spark: SparkSession, cfg: CorpusConfig) -> list[str]:
    """Run the chosen stages in order and return those that ran; an error in one stops the run.

    A stage whose settings and input files are those of its finished output is left out, so
    a run that was killed goes on after its last finished stage (``ledger.py``).
    """
    unknown = set(cfg.stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    steps = {"download": (run_download, cfg.download), "clean": (run_clean, cfg.clean),
             "deduplicate": (run_deduplicate, cfg.deduplicate),
             "tokenize": (run_tokenize, cfg.tokenize)}
    ran = []
    for stage in STAGES:
        if stage in cfg.stages:
            run, own = steps[stage]
            if run_once(spark, stage, asdict(own), _inputs(stage, own), own.output_dir,
                        lambda folder, run=run, own=own: run(spark, own, folder)):
                ran.append(stage)
    return ran
