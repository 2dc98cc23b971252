"""Bookkeeping: status, health, schema, decisions, traces, renaming."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ones(*parts: DataFrame) -> DataFrame:
    return functools.reduce(lambda a, b: a.crossJoin(b), parts)  # one-row sides


def index_status(documents: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(language, files, total_files, total_symbols, total_edges, last_indexed): a row for each language."""
    totals = _ones(documents.agg(F.count("*").alias("total_files"), F.max("mtime").alias("last_indexed")), symbols.agg(F.count("*").alias("total_symbols")), edges.agg(F.count("*").alias("total_edges")))
    return documents.groupBy("language").agg(F.count("*").alias("files")).crossJoin(F.broadcast(totals))


def health(documents: DataFrame, symbols: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts and whether there is anything indexed."""
    one = _ones(documents.agg(F.count("*").alias("documents")), symbols.agg(F.count("*").alias("symbols"), F.count_distinct("community_id").alias("communities")), edges.agg(F.count("*").alias("edges")), vectors.agg(F.count("*").alias("embeddings")))
    return one.withColumn("status", F.when((F.col("documents") > 0) & (F.col("symbols") > 0), "healthy").otherwise("needs_indexing"))


def graph_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count)."""
    return functools.reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()])


def decisions(adrs: DataFrame, status: str | None = None, k: int = 20) -> DataFrame:
    """The latest decisions (id, title, status, created_at)."""
    a = adrs if status is None else adrs.where(F.col("status") == status)
    return a.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def decide(adrs: DataFrame, title: str, context: str, decision: str, created_at: str, status: str = "accepted", supersedes: int | None = None) -> DataFrame:
    """adrs (id, title, context, decision, status, superseded_by, created_at) with one more, numbered after the last. The one it supersedes is marked."""
    if not title or not decision:
        raise ValueError("a decision has a title and a text")
    last = adrs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    values = {"title": title, "context": context, "decision": decision, "status": status, "superseded_by": None, "created_at": created_at}
    cast = lambda c, v: F.lit(v).cast(adrs.schema[c].dataType).alias(c)
    new = last.select((F.col("last") + 1).cast(adrs.schema["id"].dataType).alias("id"), *[cast(c, v) for c, v in values.items()])
    if supersedes is None:
        return adrs.select(*new.columns).unionByName(new)
    old = F.col("id") == supersedes
    marked = adrs.crossJoin(F.broadcast(last)).withColumn("superseded_by", F.when(old, F.col("last") + 1).otherwise(F.col("superseded_by")).cast(adrs.schema["superseded_by"].dataType))
    return marked.withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).select(*new.columns).unionByName(new)


def decision(adrs: DataFrame, id: int) -> DataFrame:
    """The decision of this id, or no row."""
    return adrs.where(F.col("id") == id)


def trace_edges(events: DataFrame) -> DataFrame:
    """(caller, callee, calls, payload): consecutive events of a user as calls; payload sums the JSON field k of the callee."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.from_json("props", "k long")["k"]
    steps = events.select("user_id", "ts", "event_id", F.col("event_type").alias("callee"), k.alias("k")).withColumn("caller", F.lag("callee").over(w))
    return steps.where("caller IS NOT NULL").groupBy("caller", "callee").agg(F.count("*").alias("calls"), F.sum("k").alias("payload"))


def _whole(word: str) -> str:
    return rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])"


def rename(text: Column, old: str, new: str) -> Column:
    """The text with a whole word replaced; letters, digits and ``_`` at its side make it another word."""
    return F.regexp_replace(text, _whole(old), new.replace("\\", "\\\\").replace("$", "\\$"))


def rename_preview(documents: DataFrame, old: str, new: str) -> DataFrame:
    """(doc_id, occurrences, digest) of documents that a renaming would change. A plain substring test spares the others the expression."""
    hit = documents.where(F.contains("content", F.lit(old)))
    n = F.regexp_count("content", F.lit(_whole(old)))
    return hit.select("doc_id", n.cast("long").alias("occurrences"), F.md5(rename(F.col("content"), old, new).cast("binary")).alias("digest")).where("occurrences > 0")
