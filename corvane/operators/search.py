"""Retrieval: BM25 with overlay, snippets, semantic and hybrid search, graph signals. Every ranking ends in an id, so it is total."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.tokenize import query_terms
from corvane.functions.vectors import cosine

K1, B = 1.5, 0.75
RRF = 60
GRAPH_WEIGHT, KIND_WEIGHT = 0.15, 0.10
MIN_CONFIDENCE = 0.3
KIND_BOOST = {"function": 1.30, "struct_type": 1.20, "const_value": 1.10, "variable": 1.00, "module": 1.00}


def bm25(index, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, path, score) of all documents with a term of the query; a term that the query repeats counts as often.

    Only postings of the query's terms take part. A stored segment has lengths with the postings and counts with the terms, so its
    texts aren't read, and documents are joined for their paths, after the sum over terms; a lazy index derives all of it from the texts.
    """
    scored = scores(index, query, k1, b)
    return scored.join(index.docs.select("doc_id", "path"), "doc_id").select("doc_id", "path", "score")


def scores(index, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score)."""
    terms = query_terms(query)
    spark = index.docs.sparkSession
    hits = index.postings(list(terms))
    times = spark.createDataFrame(list(terms.items()), "term string, times int")
    if "token_count" in hits.columns:
        df = index.terms(list(terms)).select("term", "df")
    else:
        hits, df = hits.join(index.docs, "doc_id"), hits.groupBy("term").agg(F.count("*").alias("df"))
    df = df.join(F.broadcast(times), "term")  # a row for each term of the query
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("token_count") / F.col("average")))
    found = hits.join(F.broadcast(df.crossJoin(F.broadcast(index.stats()))), "term")  # two sums over the corpus, one row
    return found.groupBy("doc_id").agg(F.sum(F.col("times") * idf * tf).alias("score"))


def top(scored: DataFrame, k: int, score: str = "score", tie: str = "path") -> DataFrame:
    return scored.orderBy(F.desc(score), tie).limit(k)


def with_overlay(base: DataFrame, overlay: DataFrame, tombstones: DataFrame) -> DataFrame:
    """base without tombstoned paths, and overlay; statistics are then taken over what is live."""
    return base.join(tombstones.select("path").distinct(), "path", "left_anti").select(*base.columns).unionByName(overlay.select(*base.columns))


def snippet(text: Column, term: str, before: int = 80, size: int = 300, snap: int = 40) -> Column:
    """At most ``size`` characters from ``before`` ahead of the term's first place, begun after a line break if there is one within ``snap`` further ahead."""
    at = F.greatest(F.lit(1), F.instr(F.lower(text), term) - before)
    lo = F.greatest(F.lit(1), at - snap)
    ahead = text.substr(lo, at - lo)
    back = F.instr(F.reverse(ahead), "\n")
    start = F.when(back > 0, lo + F.length(ahead) - back + 1).otherwise(at)
    return text.substr(start, F.lit(size))


def search(index, corpus: DataFrame, query: str, k: int, **tuning) -> DataFrame:
    """The k best with snippets; of texts only the k's are searched."""
    best = top(bm25(index, query, **tuning), k)
    first = next(iter(query_terms(query)))
    return corpus.select("doc_id", "content").join(F.broadcast(best), "doc_id").select("doc_id", "path", "score", snippet(F.col("content"), first).alias("snippet"))


def batches(ranked: DataFrame, size: int = 20, score: str = "score", tie: str = "path") -> DataFrame:
    """Results of a top-k with batch_index and is_last, for streaming to a client."""
    w = Window.orderBy(F.desc(score), tie)
    n = F.row_number().over(w)
    numbered = ranked.withColumn("rank", n)
    last = numbered.agg(F.max("rank").alias("n"))
    return numbered.crossJoin(F.broadcast(last)).withColumn("batch_index", F.floor((F.col("rank") - 1) / size).cast("long")).withColumn("is_last", F.floor((F.col("rank") - 1) / size) == F.floor((F.col("n") - 1) / size)).drop("n")


def semantic(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(doc_id, similarity > 0) of vectors (doc_id, vector) to the one row of query (vector); more rows are an error, see semantic_each."""
    many = F.raise_error(F.lit("semantic takes one query; semantic_each takes many"))
    one = query.agg(F.first("vector").alias("q"), F.count("*").alias("n")).where("n > 0").select(F.when(F.col("n") == 1, F.col("q")).otherwise(many).alias("q"))
    return vectors.crossJoin(F.broadcast(one)).select("doc_id", cosine(F.col("vector"), F.col("q")).alias("similarity")).where("similarity > 0")


#: queries that a task holds at once, and the side of the squares they are compared in
QUERY_BLOCK, TILE = 4096, 256
_NO_ID = np.iinfo(np.int64).min  # a null id; sorts first, as a null does


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _by_length(ids, vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length: ids, matrix. Null vectors and empty ones are like nothing; a null element counts as 0, as in cosine()."""
    n = pa.compute.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == d)
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(0.0)
        out[int(d)] = ids[rows], flat.to_numpy(zero_copy_only=False).reshape(-1, d)
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products of rows of two matrices as wide, summed in the order of their elements, so equal vectors get equal results wherever they stand."""
    out = np.zeros(np.broadcast_shapes((len(a), 1), (1, len(b))))
    for x, y in zip(a.T, b.T):
        out += x[:, None] * y[None, :]
    return out


def _norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x in a.T:
        out += x * x
    return np.sqrt(out)


def _tiles(groups: dict, ids, vectors):
    """(query ids' slice key, vector ids, similarities) of squares of vectors and queries; what cosine() calls 0 is 0."""
    for d, (own, v) in _by_length(ids, vectors).items():
        for e, (_, q) in groups.items():
            n = min(d, e)
            vn, qn = _norms(v[:, :n]), _norms(q[:, :n])
            for i in range(0, len(v), TILE):
                for j in range(0, len(q), TILE):
                    norms = vn[i : i + TILE, None] * qn[None, j : j + TILE]
                    sims = np.divide(_dots(v[i : i + TILE, :n], q[j : j + TILE, :n]), norms, out=np.zeros_like(norms), where=(norms > 0) | np.isnan(norms))
                    yield (e, j), own[i : i + TILE], sims


def _block(ids, vectors, k: int | None):
    """The function that compares batches of (doc_id, vector) with a block of queries: all that is similar, or each query's k best of a task."""

    def rows(queries, docs, sims):
        cols = [pa.array(x, pa.int64(), mask=x == _NO_ID) for x in (queries, docs)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(sims, pa.float64())], names=["query_id", "doc_id", "similarity"])

    def run(batches):
        groups, best = _by_length(_ids(ids), vectors), {}
        with np.errstate(all="ignore"):
            for batch in batches:
                for (e, j), docs, sims in _tiles(groups, _ids(batch.column(0)), batch.column(1)):
                    asked = groups[e][0][j : j + TILE]
                    if k is None:
                        i, c = np.nonzero((sims > 0) | np.isnan(sims))
                        if len(i):
                            yield rows(asked[c], docs[i], sims[i, c])
                        continue
                    sims[np.isnan(sims)] = np.inf  # first in a descending order
                    top, own = best.setdefault((e, j), (np.zeros((k, len(asked))), np.zeros((k, len(asked)), np.int64)))
                    c = np.flatnonzero(((sims >= top[-1]) & (sims > 0)).any(axis=0))
                    if len(c):
                        s = np.vstack([top[:, c], sims[:, c]])
                        d = np.vstack([own[:, c], np.broadcast_to(docs[:, None], (len(docs), len(c)))])
                        order = np.lexsort((d, -s), axis=0)[:k]
                        top[:, c], own[:, c] = np.take_along_axis(s, order, 0), np.take_along_axis(d, order, 0)
            for (e, j), (top, own) in best.items():
                i, c = np.nonzero(top > 0)
                yield rows(groups[e][0][j : j + TILE][c], own[i, c], np.where(np.isinf(top[i, c]), np.nan, top[i, c]))

    return run


def semantic_each(vectors: DataFrame, queries: DataFrame, k: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, similarity > 0) of vectors (doc_id, vector) to every row of queries (query_id, vector): all, or each query's k best.

    Ids are longs. Queries go in as many blocks as it takes, each compared with all vectors; the
    results don't depend on the number of blocks. Of the k best, a task passes on k for each query.
    """
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector")).repartition(spread, "doc_id")
    blocks = max(1, -(-queries.count() // block))
    parts = []
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)) == b).toArrow().combine_chunks()
        ids, vecs = (asked.column(c).chunk(0) if asked.num_rows else pa.array([], asked.schema.field(c).type) for c in range(2))
        parts.append(own.mapInArrow(_block(ids, vecs, k), "query_id long, doc_id long, similarity double"))
    found = functools.reduce(DataFrame.unionByName, parts)
    if k is None:
        return found
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def _ranked(df: DataFrame, score: str, tie: str, pool: int) -> DataFrame:
    """The pool's best with ranks; the window sees the pool alone."""
    best = df.orderBy(F.desc(score), tie).limit(pool)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))


def hybrid(lexical: DataFrame, similar: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of (doc_id, score) and (doc_id, similarity): (doc_id, fused, bm25, semantic)."""
    pool = max(3 * k, 50)
    a = _ranked(lexical.select("doc_id", "score"), "score", "doc_id", pool).withColumnRenamed("rank", "ra")
    s = _ranked(similar, "similarity", "doc_id", pool).withColumnRenamed("rank", "rs")
    share = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    return a.join(s, "doc_id", "full_outer").select("doc_id", (share("ra") + share("rs")).alias("fused"), F.coalesce("score", F.lit(0.0)).alias("bm25"), F.coalesce("similarity", F.lit(0.0)).alias("semantic"))


def hybrid_search(lexical: DataFrame, similar: DataFrame, query: str, k: int) -> DataFrame:
    """hybrid(), but a query that is one identifier is answered by BM25 alone."""
    q = query.strip(" \t\n\r")
    if q.replace("_", "").isalnum() and q.isascii() and any(c.isalpha() for c in q):
        return lexical.select("doc_id", F.col("score").alias("fused"), F.col("score").alias("bm25"), F.lit(0.0).alias("semantic"))
    return hybrid(lexical, similar, k)


def related(symbols: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """(document_id, relevance): confidences of distinct (neighbour, confidence) of symbols whose name contains a term, each direction and term for itself.

    Edges are read once: each gives its two directions, and one join with the hit symbols, which hold their terms, finds all of them."""
    wanted = list(dict.fromkeys(terms))
    hit = F.filter(F.array(*[F.when(F.contains(F.lower("name"), F.lit(t.lower())), i) for i, t in enumerate(wanted)]), lambda x: x.isNotNull())
    hits = symbols.select(F.col("id").alias("own"), hit.alias("terms")).where(F.size("terms") > 0)
    ends = lambda a, b, d: F.struct(F.col(a).alias("own"), F.col(b).alias("id"), F.lit(d).alias("direction"))
    both = edges.where(F.col("confidence") >= MIN_CONFIDENCE).select("confidence", F.explode(F.array(ends("src", "dst", 0), ends("dst", "src", 1))).alias("e")).select("confidence", "e.*")
    every = both.join(hits, "own").select(F.explode("terms").alias("term"), "direction", "id", "confidence").distinct()
    return every.join(symbols.select("id", "document_id"), "id").groupBy("document_id").agg(F.sum("confidence").alias("relevance"))


def kind_boost(kind: Column) -> Column:
    out = F.lit(0.80)
    for k, v in KIND_BOOST.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def kind_boosts(symbols: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(document_id, boost): the highest of the kinds of a document's symbols, of those whose name contains a term if terms are given."""
    s = symbols
    if terms:
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(F.lower("name"), F.lit(t.lower()))
        s = s.where(hit)
    return s.groupBy("document_id").agg(F.max(kind_boost(F.col("kind"))).alias("boost"))


def multi_signal(fused: DataFrame, symbols: DataFrame, edges: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k best of (doc_id, fused, ..) by fused * (1 + 0.15 * graph + 0.10 * (kind - 1))."""
    g = related(symbols, edges, terms).select(F.col("document_id").alias("doc_id"), F.col("relevance").alias("graph"))
    b = kind_boosts(symbols, terms).select(F.col("document_id").alias("doc_id"), "boost")
    both = F.broadcast(fused.orderBy(F.desc("fused"), "doc_id").limit(3 * k))
    out = both.join(g, "doc_id", "left").join(b, "doc_id", "left").withColumn("graph", F.coalesce("graph", F.lit(0.0))).withColumn("kind", F.coalesce("boost", F.lit(1.0)))
    return out.select("doc_id", "fused", "graph", "kind", (F.col("fused") * (1 + GRAPH_WEIGHT * F.col("graph") + KIND_WEIGHT * (F.col("kind") - 1))).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


#: other names of the same operator
fast_search = context_search = search


def of_document(table: DataFrame, doc_id: int) -> DataFrame:
    """Rows of one document, such as its symbols or imports, in order of place."""
    key = "doc_id" if "doc_id" in table.columns else "document_id"
    order = [c for c in ("line", "line_start", "id", "name", "target") if c in table.columns]
    return table.where(F.col(key) == doc_id).orderBy(*order)


def lookup(symbols: DataFrame, name: str) -> DataFrame:
    """The first symbol of exactly this name."""
    return symbols.where(F.col("name") == name).orderBy("document_id", "line_start", "id").limit(1)
