"""The inverted index: postings, terms and document lengths as plain tables, and segments on disk."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import words
from corvane.functions.tokenize import MAX_CHARS, PLAIN, emissions, emitted, identifiers
from corvane.sources.store import path_of

#: rows of postings in a batch
ROWS = 1 << 16


@dataclass(frozen=True)
class Index:
    """docs (doc_id, path, token_count) and counts (doc_id, term, tf, first_pos, token_count), a row for each term of each row of the corpus; both lazy."""

    docs: DataFrame
    counts: DataFrame
    #: whether counts has at most one row for a term of a row of docs, with its token_count
    single: bool = True

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, doc_id, tf, first_pos), of the given terms or all. One shuffle, for ids that have several rows; a term filter leaves only its own counts to shuffle."""
        t = self.counts if terms is None else self.counts.where(F.col("term").isin(terms))
        return t.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"))

    def terms(self) -> DataFrame:
        """(term, df, cf)."""
        return _terms(self.postings())

    def stats(self) -> DataFrame:
        """One row (n, average) of documents and their mean length."""
        return _stats(self.docs)


def _stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("token_count"), F.lit(0.0)), F.lit(1.0)).alias("average"))


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _emitted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term, pos, terms) of all that a batch's identifiers emit, in order; most distinct ones are plain words, and the others are split one by one."""
    row, word, names = words.of_text(texts, underscore=True)
    lower = pa.compute.ascii_lower(names)
    odd = np.flatnonzero(~(pa.compute.match_substring_regex(names, PLAIN).to_numpy(zero_copy_only=False) & (pa.compute.binary_length(names).to_numpy(zero_copy_only=False) <= MAX_CHARS)))
    split = [emitted(x) for x in names.take(pa.array(odd)).to_pylist()]
    n = np.ones(len(names), np.int64)
    n[odd] = [len(x) for x in split]
    starts = np.cumsum(n) - n
    # terms in the words' order: a plain word itself, of an odd one its parts
    rank = np.arange(int(n.sum()))
    plain = np.ones(len(names), bool)
    plain[odd] = False
    take = np.zeros(len(rank), np.int64)
    take[starts[plain]] = np.flatnonzero(plain)
    take[words.spread(starts[odd], n[odd])] = len(names) + np.arange(int(n[odd].sum()))
    every = pa.concat_arrays([lower, pa.array([t for x in split for t in x], pa.string())]).take(pa.array(take)).dictionary_encode()
    term = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(np.bincount(row, minlength=len(texts))) - np.bincount(row, minlength=len(texts))
    pos = np.arange(len(row)) - first[row]
    k = n[word]
    return np.repeat(row, k), term[words.spread(starts[word], k)], np.repeat(pos, k), every.dictionary


def _lengths(batches):
    for batch in batches:
        for piece in words.slices(batch, 2):
            row = _emitted(piece.column(2))[0]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(np.bincount(row, minlength=len(piece)))], names=["doc_id", "path", "token_count"])


def _counts(batches):
    for batch in batches:
        for piece in words.slices(batch, 1):
            row, term, pos, terms = _emitted(piece.column(1))
            length = np.bincount(row, minlength=len(piece))
            row, term, n, first = words.counted(row, term, max(1, len(terms)))
            for lo in range(0, len(row), ROWS):
                r, t = row[lo : lo + ROWS], term[lo : lo + ROWS]
                cols = [piece.column(0).take(pa.array(r)), terms.take(pa.array(t)), pa.array(n[lo : lo + ROWS]), pa.array(pos[first[lo : lo + ROWS]]), pa.array(length[r])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "term", "tf", "first_pos", "token_count"])


def build(corpus: DataFrame, symbols: DataFrame | None = None) -> Index:
    """An index of corpus (doc_id, path, content). Names of ``symbols`` (doc_id, name) are tokens once more, at position 0: the boost of a symbol's name. Null content has no tokens.

    A row's terms are counted where it is read, in Arrow batches, so no token is shuffled.
    """
    kind, path = (corpus.schema[c].dataType.simpleString() for c in ("doc_id", "path"))
    docs = corpus.select("doc_id", "path", "content").mapInArrow(_lengths, f"doc_id {kind}, path {path}, token_count long")
    counts = corpus.select("doc_id", "content").mapInArrow(_counts, f"doc_id {kind}, term string, tf long, first_pos long, token_count long")
    if symbols is not None:
        boost = symbols.select("doc_id", F.explode(F.flatten(F.transform(identifiers(F.col("name")), emissions))).alias("term"))
        more = boost.groupBy("doc_id").agg(F.count("*").alias("more"))
        docs = docs.join(more, "doc_id", "left").select("doc_id", "path", (F.col("token_count") + F.coalesce("more", F.lit(0))).alias("token_count"))
        unknown = F.lit(None).cast("long").alias("token_count")  # a boosted document's length is in docs
        counts = counts.select("doc_id", "term", "tf", "first_pos", unknown).unionByName(boost.select("doc_id", "term", F.lit(1).cast("long").alias("tf"), F.lit(0).cast("long").alias("first_pos"), unknown))
    return Index(docs, counts, symbols is None)


@dataclass(frozen=True)
class Overlaid:
    """A segment under an overlay: documents of ``dead`` (path) don't count, those of the overlay do. Only the overlay's texts are read. The two have no doc_id in common."""

    base: Segment
    overlay: Index
    dead: DataFrame

    @property
    def docs(self) -> DataFrame:
        columns = ["doc_id", "path", "token_count"]
        return self.base.docs.join(self.dead, "path", "left_anti").select(*columns).unionByName(self.overlay.docs.select(*columns))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        gone = self.base.docs.join(self.dead, "path", "left_semi").select("doc_id")
        new = self.overlay.postings(terms).join(self.overlay.docs.select("doc_id", "token_count"), "doc_id")
        return self.base.postings(terms).join(gone, "doc_id", "left_anti").unionByName(new)

    def terms(self, terms: list[str] | None = None) -> DataFrame:
        return _terms(self.postings(terms))

    def stats(self) -> DataFrame:
        return _stats(self.docs)


def write_segment(index: Index, root: str, buckets: int = 64) -> str:
    """Writes a new immutable segment and then moves the project's pointer to it; readers see the old or the new one.

    Postings are laid out by a hash of the term and sorted, so that a query reads the directories and row groups of its terms alone;
    each has its document's length, so that ranking needs no table of documents. Terms with their counts and the corpus' statistics are stored beside them.
    """
    spark = index.docs.sparkSession
    path = f"{root}/segments/{uuid.uuid4().hex}"
    index.docs.write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    # where every id has one row, its counts are postings with their length as they stand; a boost or shared ids have to be summed and joined
    whole = docs.agg(F.count("doc_id") == F.count("*")).first()[0] and index.single and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    found = index.counts if whole else index.postings().join(docs.select("doc_id", "token_count"), "doc_id")
    full = found.select("term", "doc_id", "tf", "first_pos", "token_count").withColumn("bucket", bucket)
    # several tasks a bucket, by document, so that a term that most documents have isn't one task's
    full.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{path}/postings")
    _terms(spark.read.schema(full.schema).parquet(f"{path}/postings")).withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    _stats(docs).coalesce(1).write.parquet(f"{path}/stats")
    _point(spark, root, path, buckets)
    return path


def _point(spark: SparkSession, root: str, path: str, buckets: int) -> None:
    """Pointers are numbered and never overwritten, so a reader finds one at any moment: the newest that is complete."""
    fs, base = path_of(spark, f"{root}/pointers")
    n = 1 + max(_pointers(fs, base), default=0)
    spark.createDataFrame([(path, buckets)], "path string, buckets int").coalesce(1).write.parquet(f"{root}/pointers/.new-{n}")
    if not fs.rename(path_of(spark, f"{root}/pointers/.new-{n}")[1], path_of(spark, f"{root}/pointers/{n}")[1]):
        raise OSError(f"can't move the pointer of {root}")


def _pointers(fs, base) -> list[int]:
    return [int(f.getPath().getName()) for f in fs.listStatus(base) if f.getPath().getName().isdigit()] if fs.exists(base) else []


def projects(spark: SparkSession, root: str) -> DataFrame:
    """(project, segments, documents): the projects under root, by name, with the number of their segments and the documents of the current one."""
    fs, base = path_of(spark, root)
    rows = []
    for name in sorted(f.getPath().getName() for f in fs.listStatus(base)) if fs.exists(base) else []:
        own, p = path_of(spark, f"{root}/{name}/pointers")
        if found := _pointers(own, p):
            rows.append((name, len(found), open_segment(spark, f"{root}/{name}").docs.count()))
    return spark.createDataFrame(rows, "project string, segments long, documents long")


def delete_project(spark: SparkSession, root: str, project: str) -> bool:
    """Removes a project with its segments; whether there was one."""
    if not project or "/" in project or project.startswith("."):
        raise ValueError("not a project's name")
    fs, p = path_of(spark, f"{root}/{project}")
    return bool(fs.exists(p) and fs.delete(p, True))


@dataclass(frozen=True)
class Segment:
    """A stored index; postings() reads only the buckets of the terms asked for."""

    docs: DataFrame
    stored: DataFrame
    buckets: int
    stored_terms: DataFrame
    stored_stats: DataFrame

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        if terms is None:
            return self.stored.drop("bucket")
        return self._of(self.stored, terms)

    def terms(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df, cf), of the given terms or all."""
        return self.stored_terms.drop("bucket") if terms is None else self._of(self.stored_terms, terms)

    def stats(self) -> DataFrame:
        return self.stored_stats

    def _of(self, table: DataFrame, terms: list[str]) -> DataFrame:
        spark = table.sparkSession
        hashed = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        at = sorted({r[0] for r in hashed.collect()})  # a local relation, evaluated without a job
        return table.where(F.col("bucket").isin(at) & F.col("term").isin(terms)).drop("bucket")


def open_segment(spark: SparkSession, root: str) -> Segment:
    """The segment that the project's newest pointer names."""
    fs, base = path_of(spark, f"{root}/pointers")
    path, buckets = spark.read.schema("path string, buckets int").parquet(f"{root}/pointers/{max(_pointers(fs, base))}").first()
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    docs = spark.read.parquet(f"{path}/docs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return Segment(docs, table("postings", f"term string, doc_id {kind}, tf long, first_pos long, token_count long, bucket int"), buckets, table("terms", "term string, df long, cf long, bucket int"), table("stats", "n long, average double"))
