"""The corpus pipeline: from documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of docs.
Stages that change texts renew n_chars. A text that line dedup empties stays. Columns beyond those of
documents are kept, also where an operator's result has the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import decontam, linededup, neardup, packing, toxicity
from corvane.llm.queries import vocabulary
from corvane.llm.runtime import plain, source, table


def _kept(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage keeps of docs: its other columns are hidden from the operator under names of their own."""
    inner, back = plain(docs, ["doc_id", "text", *[c for c in ("n_chars",) if c in docs.columns]])
    return back(stage(inner).select(*inner.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under one half. Learns from the labels outside the held-out fifth."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, source(spark, sf_dir, "labels"), held_out)
    return _kept(docs, lambda d: toxicity.score(d, model, d.columns).where("score < 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose key is found in at least ten of them."""

    def stage(d):
        out = linededup.line_dedup(d, min_docs=10, min_length=1)
        return out.withColumn("n_chars", F.char_length("text").cast(d.schema["n_chars"].dataType)) if "n_chars" in d.columns else out

    return _kept(docs, stage)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies."""
    return neardup.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, however long they are."""
    return _kept(docs, lambda d: decontam.decontaminate(d, source(spark, sf_dir, "benchmark")).where("n_hit = 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return packing.pack(docs, *vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: learned scores and token ids can't be had from SQL: tests/llm holds the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
