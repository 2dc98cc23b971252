"""The stored tables as the engine's data model: a corpus of texts, a symbol graph, vectors.

``corpus`` has doc_id, path, language, content, mtime; the graph has ``symbols`` and ``edges``.
Parts are symbols (their brand's number is the document), consecutive parts of an order are
``calls`` edges with confidence 1 - discount, one for each pair with the highest confidence.
All are lazy: columns and filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

KIND = {"STANDARD": "function", "MEDIUM": "method", "PROMO": "struct_type", "LARGE": "const_value", "SMALL": "variable"}

CORPUS_SQL = "corpus AS (SELECT doc_id, concat(source, '/', doc_id) AS path, lang AS language, text AS content, n_chars AS mtime FROM documents)"
SYMBOLS_SQL = (
    "symbols AS (SELECT p_partkey AS id, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS document_id, p_name AS name, CASE p_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND.items())
    + " ELSE 'module' END AS kind, p_size AS line_start, p_size + 3 AS line_end, CASE WHEN p_size <= 45 THEN CAST(p_size // 10 AS BIGINT) END AS community_id FROM part)"
)
EDGES_SQL = """edges AS (SELECT src, dst, 'calls' AS edge_type, max(1 - l_discount) AS confidence FROM (
  SELECT l_partkey AS src, l_discount, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_discount) AS dst FROM lineitem
) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"), F.col("n_chars").alias("mtime"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for k, v in KIND.items():
        kind = F.coalesce(kind, F.when(F.col("p_type") == k, v))
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("document_id"),
        F.col("p_name").alias("name"),
        F.coalesce(kind, F.lit("module")).alias("kind"),
        F.col("p_size").alias("line_start"),
        (F.col("p_size") + 3).alias("line_end"),
        F.when(F.col("p_size") <= 45, F.floor(F.col("p_size") / 10)).alias("community_id"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order has few lines, so the window's groups are small; both aggregates are partial."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_discount")
    pairs = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), "l_discount", F.lead("l_partkey").over(w).alias("dst"))
    return pairs.where("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.max(1 - F.col("l_discount")).alias("confidence")).select("src", "dst", F.lit("calls").alias("edge_type"), "confidence")


def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), "path", "language", "mtime")
