"""Incremental maintenance: snapshot diff, applying changes, overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def diff(current: DataFrame, stored: DataFrame, by: str = "mtime") -> DataFrame:
    """(path, change): added, modified (``by`` differs) or deleted paths of two snapshots; one shuffle of paths and ``by`` alone."""
    c = current.select("path", F.col(by).alias("now"), F.lit(True).alias("here"))
    s = stored.select("path", F.col(by).alias("then"), F.lit(True).alias("there"))
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("then")), "modified")
    return c.join(s, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def apply(documents: DataFrame, symbols: DataFrame, edges: DataFrame, changes: DataFrame, new_documents: DataFrame, new_symbols: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph's tables after the changes: what modified and deleted documents had goes, with edges at either end; what was extracted anew comes."""
    gone = changes.where(F.col("change").isin("modified", "deleted")).select("path")
    old = documents.join(gone, "path", "left_semi").select(F.col("id").alias("document_id"))
    out = symbols.join(old, "document_id", "left_semi").select("id")
    kept = edges.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return (
        documents.join(gone, "path", "left_anti").select(*documents.columns).unionByName(new_documents),
        symbols.join(old, "document_id", "left_anti").select(*symbols.columns).unionByName(new_symbols),
        kept.select(*edges.columns).unionByName(new_edges),
    )


def overlay(current: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overlay, tombstones): rows of current whose content is new or changed, and paths of base that changed or are gone; both are (path, hash, ..). Applying it twice changes nothing."""
    b, c = base.select("path", "hash"), current.select("path", "hash")
    return current.join(b, ["path", "hash"], "left_anti"), b.join(c, ["path", "hash"], "left_anti").select("path")


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target with rows in place of those of the same key."""
    return target.join(rows.select(key), key, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))
