"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, embdup, licenses, linededup, neardup, packing, quality, secrets, toxicity, trainorder
from .runtime import shared_dir, source


def _held_out(mod: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod == rest


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs documents and writes the sequences in training order; the rows are what the shards' files hold."""
    docs = source(spark, sf_dir, "documents")
    return trainorder.materialise(docs, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", *vocabulary())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, _held_out(5, 0))
    return toxicity.score(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def vocabulary() -> tuple[str, str]:
    """The places of the public vocabulary: for tokenizers, and its ranks for tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, _held_out(4, 2))
    return quality.score(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    return packing.pack(docs, *vocabulary())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.line_dedup(docs, min_docs=10, min_length=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.decontaminate(docs, source(spark, sf_dir, "benchmark"), size=13)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is the owner, a source's texts of one language a repository."""
    docs = source(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secrets.scan(docs, repo=F.to_json(F.array("source", "lang")), owner=F.col("source"))
    repos = F.aggregate("live", F.lit(0).cast("long"), lambda n, x: F.greatest(n, x["n_repos"])).alias("most_live_repos")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", repos)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(source(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.groups(source(spark, sf_dir, "embeddings"))


QUERIES = {"op6_training_order": op6_training_order, "op9_embedding_dedup": op9_embedding_dedup, "op8_near_dedup": op8_near_dedup, "op1_license_scan": op1_license_scan, "op10_secret_scan": op10_secret_scan, "op2_quality": op2_quality, "op3_packing": op3_packing, "op4_line_dedup": op4_line_dedup, "op5_decontamination": op5_decontamination, "op7_toxicity": op7_toxicity}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL: dict[str, str] = {
    "op4_line_dedup": f"""
WITH numbered AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, r, i, parts[i] AS line,
    translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_A}', '{_Z}') AS key
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM numbered)
), bad AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(bad.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN bad USING (key) GROUP BY r""",
    "op5_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '{_ALNUM}') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), place AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT r, i, place.n, item FROM place JOIN win ON place.n = win.n AND place.win = win.win),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN items USING (r)""",
    "op8_near_dedup": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
}
