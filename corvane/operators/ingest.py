"""From a tree of files, or a table of them, to what the engine stores: documents, symbols, edges and an index segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators import extract, index
from corvane.sources import files, store

#: what an extracted row is, where it isn't a symbol
EDGE_KINDS = ("contains", "imports", "calls")


def graph_of(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents (id, path, language, mtime), symbols and edges of sources (path, language, content, mtime).

    Ids are hashes of what makes a row one, so a repeated run gives the same and no numbering needs a shuffle. Edges are resolved by
    name over all symbols; one whose end has no symbol, such as an import of a file, has no edge.
    """
    own = sources.withColumn("id", F.xxhash64("path"))
    found = store.stored(extract.extract(own.select(F.col("id").alias("doc_id"), "language", "content")), "extracted")
    at = F.xxhash64("doc_id", "kind", "target", "first_line")
    made = found.where(~F.col("kind").isin(*EDGE_KINDS))
    symbols = made.select(at.alias("id"), F.col("doc_id").alias("document_id"), F.col("target").alias("name"), "kind", F.col("first_line").alias("line_start"), F.col("last_line").alias("line_end"))
    links = found.where(F.col("kind").isin(*EDGE_KINDS)).select("source", "target", F.col("kind").alias("edge_type"), F.lit(1.0).alias("confidence"))
    return own.select("id", "path", "language", "mtime"), symbols, extract.resolve(links, symbols)


def counts(documents: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, kind, n): what a run has stored."""
    part = lambda df, entity, kind: df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(entity).alias("entity"), "kind", "n")
    return part(documents, "document", "language").unionByName(part(symbols, "symbol", "kind")).unionByName(part(edges, "edge", "edge_type"))


def index_repository(spark: SparkSession, root: str, out: str, rules: list[str] = ()) -> DataFrame:
    """Scans a tree, extracts and stores: tables documents, symbols and edges and a segment under ``out``, each put in place whole. Returns counts()."""
    found = store.stored(files.contents(spark, root, list(rules)), "files")
    tables = dict(zip(("documents", "symbols", "edges"), graph_of(found)))
    for name, df in tables.items():
        store.replace(df, f"{out}/{name}")
    corpus = found.select(F.xxhash64("path").alias("doc_id"), "path", "content")
    stored = {name: spark.read.parquet(f"{out}/{name}") for name in tables}
    index.write_segment(index.build(corpus, stored["symbols"].select(F.col("document_id").alias("doc_id"), "name")), out)
    return counts(**stored)
