"""Near-duplicate removal over the whole table.

Documents whose MinHash signatures agree on a whole band are copies, as are copies of
copies. Signatures are built in the scan, and from there on only ids and band
keys move: text is shuffled once, for the surviving rows' anti join. Documents with
equal signatures are one node from the start, however many there are, and a band bucket
is linked by one edge per member to its least id, which connects the same documents as
all pairs would.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.minhash import band_layout, lsh_bands, minhash_signature
from textloom.functions.text import jaccard, shingle_words
from textloom.operators.graph import MAX_ROUNDS, connected_components
from textloom.operators.positions import with_position
from textloom.operators.skew import HOT_ROWS, join_ids, join_per_key
from textloom.operators.spread import spread
from textloom.operators.storage import cut


def layout(threshold: float, num_perm: int, bands: int | None, rows: int | None) -> tuple[int, int]:
    """Given bands and rows, or those that fit the threshold best."""
    if bands is None:
        return band_layout(threshold, num_perm)
    rows = num_perm // bands if rows is None else rows
    if bands * rows > num_perm:
        raise ValueError(f"{bands} bands of {rows} rows need more than {num_perm} permutations")
    return bands, rows


def signed(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    num_perm: int = 128,
    threshold: float = 0.8,
    bands: int | None = None,
    rows: int | None = None,
    unicode: bool = False,
) -> DataFrame:
    """(id, band_keys, whole): band keys and one key over all bands, made in the scan."""
    bands, rows = layout(threshold, num_perm, bands, rows)
    signature = minhash_signature(shingle_words(F.col(text_col), unicode), num_perm)
    return (
        spread(df.where(F.col(text_col).isNotNull()).select(id_col, text_col), id_col)
        .select(F.col(id_col).alias("id"), signature.alias("signature"))
        .select("id", lsh_bands(F.col("signature"), bands, rows).alias("band_keys"))
        .withColumn("whole", F.unhex(F.md5(F.concat(*[F.col("band_keys")[i] for i in range(bands)]))))
    )


def one_per_signature(signed_rows: DataFrame) -> DataFrame:
    """Least id and member count per distinct signature; combines map-side."""
    return signed_rows.groupBy("whole").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("band_keys").alias("band_keys")
    )


def band_members(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.explode("band_keys").alias("bucket"))


def band_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, anchor, members) of the buckets shared by several nodes."""
    return (
        band_members(nodes).groupBy("bucket")
        .agg(F.min("id").alias("anchor"), F.count("*").alias("members"))
        .where("members > 1")
    )


def lsh_candidates(
    nodes: DataFrame, total_rows: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Distinct edges (src, dst), src < dst: members of a bucket to its least id."""
    members = band_members(nodes)
    return (
        join_per_key(members, band_buckets(nodes), ["bucket"], "members", total_rows, hot_rows)
        .where("id <> anchor")
        .select(F.col("anchor").alias("src"), F.col("id").alias("dst"))
        .distinct()
    )


# Edges of one anchor that meet one copy of its words.
EDGES_PER_PART = 1000


def edge_similarity(
    edges: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    unicode: bool = False, edges_per_part: int = EDGES_PER_PART,
) -> DataFrame:
    """Exact Jaccard similarity of the word sets at both ends of each edge.

    Only documents with an edge are read into word sets. The words of an anchor are copied
    to one part for every ``EDGES_PER_PART`` of its edges, which are dealt to these parts, so that no task gets
    more of one anchor and no set of words, of whatever size, is broadcast.
    """
    edges = cut(edges)
    ends = edges.select(F.explode(F.array("src", "dst")).alias(id_col)).distinct()
    words = cut(spread(join_ids(df.select(id_col, text_col), ends, id_col, "left_semi"), id_col).select(
        F.col(id_col).alias("id"), shingle_words(F.col(text_col), unicode).alias("words")
    ))
    degrees = cut(edges.groupBy("src").agg(F.count("*").alias("degree")).withColumn(
        "parts", F.ceil(F.col("degree") / edges_per_part).cast("bigint")))
    left = words.join(degrees, words.id == degrees.src).select(
        "src", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("words").alias("a"))
    right = words.select(F.col("id").alias("dst"), F.col("words").alias("b"))
    dealt = join_per_key(edges, degrees, ["src"], "degree").select(
        "src", "dst", F.pmod(F.xxhash64("dst"), F.col("parts")).alias("part"))
    return (
        dealt.join(right.hint("merge"), "dst").join(left.hint("merge"), ["src", "part"])
        .select("src", "dst", jaccard(F.col("a"), F.col("b")).alias("jaccard"))
    )


class Duplicates:
    """Signatures, edges and components of one table, each cut once and reused."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 num_perm: int = 128, threshold: float = 0.8, bands: int | None = None,
                 rows: int | None = None, unicode: bool = False, verify: bool = False,
                 max_rounds: int = MAX_ROUNDS, hot_rows: int = HOT_ROWS):
        self.df, self.id_col = df, id_col
        self.signed = cut(signed(df, id_col, text_col, num_perm, threshold, bands, rows, unicode))
        self.total = self.signed.count()
        self.nodes = cut(one_per_signature(self.signed))
        n_bands = layout(threshold, num_perm, bands, rows)[0]
        self.edges = lsh_candidates(self.nodes, self.total * n_bands, hot_rows)
        if verify:
            self.edges = (
                edge_similarity(self.edges, df, id_col, text_col, unicode)
                .where(F.col("jaccard") >= threshold).select("src", "dst")
            )
        self.components = connected_components(self.edges, max_rounds, hot_rows)
        self.hot_rows = hot_rows

    def clusters(self) -> DataFrame:
        """(id, component) of every document that has a copy; component = least id."""
        nodes = self.nodes.join(self.components, self.nodes.id == F.col("node"), "left")
        groups = nodes.where("component is not null or copies > 1").select(
            "whole", "copies", F.coalesce("component", "id").alias("component")
        )
        return join_per_key(
            self.signed.select("whole", "id"), groups, ["whole"], "copies",
            self.total, self.hot_rows,
        ).select("id", "component")

    def dropped(self) -> DataFrame:
        """Ids that have a smaller id in their component."""
        return self.clusters().where("id <> component").select(F.col("id").alias(self.id_col))

    def kept(self) -> DataFrame:
        """Rows of the table that are the first of their component or have no copy."""
        return join_ids(self.df, self.dropped(), self.id_col, "left_anti")


def dedup_documents(df: DataFrame, **options) -> DataFrame:
    """Documents without a copy, and the one with the least id of each component.

    Rows with null text have no signature and are all kept.
    """
    return Duplicates(df, **options).kept()


def unclustered(found: Duplicates) -> DataFrame:
    """Rows without any copy."""
    ids = found.clusters().select(F.col("id").alias(found.id_col))
    return join_ids(found.df, ids, found.id_col, "left_anti")


def representatives(found: Duplicates) -> DataFrame:
    """One row per cluster: the one with the least id."""
    first = found.clusters().where("id = component").select(F.col("id").alias(found.id_col))
    return join_ids(found.df, first, found.id_col, "left_semi")


def sorted_clusters(clusters: DataFrame) -> DataFrame:
    """Members in canonical order with their position over all clusters."""
    return with_position(clusters, ["component", "id"])


def dedup_stats(found: Duplicates) -> DataFrame:
    """One row: documents signed, distinct edges, components, dropped and kept rows."""
    rows = found.df.select(F.lit(1).alias("document"))
    members = found.clusters().select("component")
    return (
        rows.unionByName(members, allowMissingColumns=True)
        .agg(
            F.sum("document").alias("documents"),
            F.count("component").alias("clustered"),
            F.count_distinct("component").alias("components"),
        )
        .withColumn("dropped", F.col("clustered") - F.col("components"))
        .withColumn("kept", F.col("documents") - F.col("dropped"))
    )
