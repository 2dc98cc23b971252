"""Findings of the second round: results that differed on larger tables, and steps that grew faster than their input."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import vectors
from corvane.functions.tokenize import TOKENS_SQL, split_identifier
from corvane.operators import graph, index
from corvane.plans import registry
from corvane.plans import registry


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_capital_after_a_digit_begins_a_part(spark):
    text = "ABC9D 7UP A2B3 X1 ABC123 Ab2 9 A Q7XYa2 2ab AB12cd"
    got = index.build(spark.createDataFrame([(1, "a", text)], "doc_id long, path string, content string"))
    c = duckdb.connect()
    c.execute("CREATE TABLE src AS SELECT 1::BIGINT AS doc_id, ? AS content", [text])
    want = c.execute(f"WITH {TOKENS_SQL} SELECT term, doc_id, count(*), min(pos) FROM tokens GROUP BY term, doc_id").fetchall()
    assert rows(got.postings()) == sorted(want, key=str)
    assert got.docs.first().token_count == sum(n for _, _, n, _ in want)


def test_no_path_is_no_row(spark, monkeypatch):
    far = spark.createDataFrame([(1, 2, "calls", 1.0)], "src long, dst long, edge_type string, confidence double")
    monkeypatch.setattr(registry, "edges", lambda spark, sf: far)
    monkeypatch.setattr(registry, "load", lambda spark, sf, name: spark.createDataFrame([(1,), (2,), (3,)], "p_partkey long"))
    assert registry.QUERIES["trace_path"](spark, "").collect() == []
    monkeypatch.setattr(registry, "load", lambda spark, sf, name: spark.createDataFrame([(1,), (2,)], "p_partkey long"))
    assert [tuple(r) for r in registry.QUERIES["trace_path"](spark, "").collect()] == [(True, 1, 1.0, "1>2")]


def test_short_texts_md5():
    texts = [b"abc", b"zzz", b"0a9", b"abcd", b"abcde", b"abcdef", b"the-0"]
    for n in (3, 4, 5, 6):
        own = [t for t in texts if len(t) == n]
        got = vectors._md5(np.array([int.from_bytes(t, "little") for t in own], np.uint64), n)
        assert got.tolist() == [int.from_bytes(hashlib.md5(t).digest()[:4], "big") for t in own]


def test_embeddings_bring_only_sums_together(spark):
    texts = [(1, "alpha Beta alpha ab"), (2, None), (3, "ab c"), (1, "gamma, alpha"), (None, "delta"), (4, "é" + "x" * 300 + "é Ring_bolt " * 3)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    out = vectors.embed_text(df, "id", "text")
    assert "Join" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Aggregate" not in plan
    c = duckdb.connect()
    c.execute("CREATE TABLE texts (id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO texts VALUES (?, ?)", texts)
    sql = f"WITH t AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS token FROM texts), {registry._EMBED} {registry._UNIT}"
    assert rows(out.select("id", "slot", F.round("weight", 6))) == sorted(c.execute(sql).fetchall(), key=str)
    names = spark.createDataFrame([(1, "größeItemÄtna"), (2, "a_b"), (3, None)], "id long, name string")
    parts = [r[0] for r in names.where("id = 1").select(F.explode(split_identifier(F.col("name")))).collect()]
    weights = {}
    for t in (x.lower() for x in ("größeItemÄtna", *parts)):
        g = [t[i : i + n] for n in (3, 4, 5, 6) for i in range(len(t) - n + 1)]
        for s in {int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 384 for x in g}:
            weights[s] = weights.get(s, 0) + 1 / len(g)
    norm = sum(w * w for w in weights.values()) ** 0.5
    assert {r.slot: r.weight for r in vectors.embed_identifier(names, "id", "name").where("id = 1").collect()} == pytest.approx({s: w / norm for s, w in weights.items()})


def test_one_id_of_many_rows_is_one_vector(spark):
    df = spark.range(30_000).select(F.lit(7).alias("id"), F.concat(F.lit("word"), F.col("id") % 5).alias("text"))
    five = spark.createDataFrame([(7, " ".join(f"word{i}" for i in range(5)))], "id int, text string")
    got, want = ({r.slot: r.weight for r in vectors.embed_text(x, "id", "text").collect()} for x in (df, five))
    assert got == pytest.approx(want)


def test_counts_of_a_row_need_no_shuffle(spark, tmp_path):
    texts = [(1, "a", "parseRing ring_of HTTPServer x9Y " + "_" * 3 + "a" * 300 + " the é the"), (2, "b", None), (3, "c", ""), (4, "d", "endThe"), (5, "e", "the aB" + "cD" * 20)]
    made = index.build(spark.createDataFrame(texts, "doc_id long, path string, content string").repartition(2))
    assert "Exchange hashpartitioning" not in made.counts._jdf.queryExecution().executedPlan().toString()
    c = duckdb.connect()
    c.execute("CREATE TABLE src (doc_id BIGINT, path VARCHAR, content VARCHAR)")
    c.executemany("INSERT INTO src VALUES (?, ?, ?)", texts)
    want = c.execute(f"WITH {TOKENS_SQL} SELECT term, doc_id, count(*), min(pos), (SELECT count(*) FROM tokens t WHERE t.doc_id = tokens.doc_id) FROM tokens GROUP BY term, doc_id").fetchall()
    index.write_segment(made, f"{tmp_path}/p")
    assert rows(index.open_segment(spark, f"{tmp_path}/p").postings()) == sorted(want, key=str)
    twice = index.build(spark.createDataFrame([(1, "a", "ring the ring"), (1, "b", "no ring")], "doc_id long, path string, content string"))
    assert rows(twice.postings()) == [("no", 1, 1, 0), ("ring", 1, 3, 0), ("the", 1, 1, 1)]


def test_a_trace_ends_with_its_frontier(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2, "calls", 1.0), (2, 3, "calls", 0.9), (3, 1, "calls", 0.8), (8, 9, "calls", 1.0)], "src long, dst long, edge_type string, confidence double")
    plans, own = [], graph.neighbours
    monkeypatch.setattr(graph, "neighbours", lambda *a, **k: plans.append(own(*a, **k)) or plans[-1])
    want = None
    for size in (1 << 20, 0):
        monkeypatch.setattr(graph, "FRONTIER", size)
        seen, met = graph.trace(e, 1, 50)
        assert rows(seen) == [(1, 0), (2, 1), (3, 2)] and len(plans) == 3
        want = want or rows(met)
        assert rows(met) == want and len(want) == 3
        if size:
            assert all("ResolvedHint (strategy=broadcast)" in p._jdf.queryExecution().analyzed().toString() for p in plans)
        plans.clear()
