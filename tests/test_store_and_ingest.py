"""Stored tables and segments, the scan-extract-store run, decisions, contexts and settings."""

import os

import pytest
from pyspark.sql import functions as F

from corvane import config
from corvane.operators import context, graph, index, ingest, ops, search
from corvane.sources import store

TEXTS = [(1, "a.md", "parse the ring, parseRing and the_ring"), (2, "b.md", "the ring was bolt bolt"), (3, "c.md", None), (4, "d.md", "was was the")]
CODE = {
    "src/main.zig": 'const std = @import("std");\npub fn main() void {\n    run_all();\n}\n',
    "src/run.zig": "pub const Runner = struct {\n    pub fn start() void {\n        main();\n    }\n};\nfn run_all() void {\n    start();\n}\n",
    "zig-out/skip.zig": "fn skipped() void {}\n",
    "notes.txt": "fn neither() void {}\n",
}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, path string, content string")


def scored(df):
    return {r.doc_id: (r.path, pytest.approx(r.score)) for r in df.collect()}


def test_a_segment_ranks_as_the_lazy_index(spark, texts, tmp_path):
    lazy = index.build(texts)
    index.write_segment(lazy, f"{tmp_path}/p")
    seg = index.open_segment(spark, f"{tmp_path}/p")
    assert rows(seg.postings().drop("token_count")) == rows(lazy.postings()) and rows(seg.terms()) == rows(lazy.terms()) and rows(seg.stats()) == rows(lazy.stats())
    assert rows(seg.terms(["ring", "no"])) == [("ring", 2, 4)]
    for q in ("the ring", "bolt bolt was", "nothing", "RING parse"):
        want = scored(search.bm25(lazy, q))
        assert scored(search.bm25(seg, q)) == want and {r.doc_id: pytest.approx(r.score) for r in search.scores(seg, q).collect()} == {d: s for d, (_, s) in want.items()}
    plan = search.scores(seg, "the ring")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "/docs" not in plan
    (empty := index.write_segment(index.build(texts.limit(0)), f"{tmp_path}/q"))
    assert empty and search.bm25(index.open_segment(spark, f"{tmp_path}/q"), "the").collect() == []


def test_an_overlay_counts_as_an_index_of_what_is_live(spark, texts, tmp_path):
    index.write_segment(index.build(texts), f"{tmp_path}/p")
    dead = texts.where("doc_id = 2").select("path")
    new = spark.createDataFrame([(9, "b.md", "ring ring of the new"), (10, "z.md", "nothing here")], texts.schema)
    over = index.Overlaid(index.open_segment(spark, f"{tmp_path}/p"), index.build(new), dead)
    live = index.build(search.with_overlay(texts, new, dead))
    for q in ("the ring", "was", "new bolt"):
        assert scored(search.bm25(over, q)) == scored(search.bm25(live, q))
    assert rows(over.docs) == rows(live.docs.select("doc_id", "path", "token_count"))


def test_pointers_and_projects(spark, texts, tmp_path):
    root = str(tmp_path)
    index.write_segment(index.build(texts.limit(0)), f"{root}/one")
    old = index.open_segment(spark, f"{root}/one")
    index.write_segment(index.build(texts), f"{root}/one")
    index.write_segment(index.build(texts), f"{root}/two")
    assert old.docs.count() == 0  # a reader keeps what it opened
    assert rows(index.projects(spark, root)) == [("one", 2, 4), ("two", 1, 4)]
    assert index.delete_project(spark, root, "one") and not index.delete_project(spark, root, "one")
    assert rows(index.projects(spark, root)) == [("two", 1, 4)]
    for bad in ("", "../two", ".."):
        with pytest.raises(ValueError):
            index.delete_project(spark, root, bad)


def test_once_is_built_again_when_its_source_changes_or_it_is_gone(spark, tmp_path):
    path, built = f"{tmp_path}/t", []
    spark.range(3).write.parquet(path)
    build = lambda p: (built.append(p), spark.range(1).write.parquet(f"{p}/x"))
    first = store.once(spark, "thing", [path], build)
    assert store.once(spark, "thing", [path], build) == first and len(built) == 1
    spark.range(9).write.mode("overwrite").parquet(path)
    second = store.once(spark, "thing", [path], build)
    assert second != first and len(built) == 2
    store.drop(spark, second)
    assert store.once(spark, "thing", [path], build) != second and len(built) == 3


def test_append_and_replace(spark, tmp_path):
    path = f"{tmp_path}/t"
    one = spark.createDataFrame([(1, "a")], "id long, name string")
    store.append(one, path)
    store.append(one.select("name", "id"), path)
    assert rows(spark.read.parquet(path)) == [(1, "a"), (1, "a")]
    with pytest.raises(ValueError):
        store.append(one.withColumn("more", F.lit(1)), path)
    store.replace(spark.read.parquet(path).withColumn("id", F.col("id") + 1), path)
    assert rows(spark.read.parquet(path)) == [(2, "a"), (2, "a")]


def test_index_repository(spark, tmp_path):
    for name, text in CODE.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    out = f"{tmp_path}/out"
    want = [("document", "zig", 2), ("edge", "calls", 3), ("edge", "contains", 1), ("symbol", "const_value", 1), ("symbol", "function", 2), ("symbol", "method", 1), ("symbol", "struct_type", 1)]
    assert rows(ingest.index_repository(spark, f"{tmp_path}/tree", out)) == want
    first = rows(spark.read.parquet(f"{out}/symbols"))
    os.remove(tmp_path / "tree/src/main.zig")
    assert ("document", "zig", 1) in rows(ingest.index_repository(spark, f"{tmp_path}/tree", out))
    (tmp_path / "tree/src/main.zig").write_text(CODE["src/main.zig"])
    ingest.index_repository(spark, f"{tmp_path}/tree", out)
    assert rows(spark.read.parquet(f"{out}/symbols")) == first  # ids are the same again
    s, e = spark.read.parquet(f"{out}/symbols"), spark.read.parquet(f"{out}/edges")
    start = search.lookup(s.withColumn("document_id", F.col("document_id")), "main").first().id
    named = {r.id: r.name for r in s.collect()}
    assert {named[r.id] for r in graph.trace(e, start, 3)[0].collect()} == {"main", "run_all", "start"}
    assert search.top(search.bm25(index.open_segment(spark, out), "Runner"), 5).count() == 1
    doc = s.where("name = 'Runner'").first().document_id
    assert [r.name for r in search.of_document(s, doc).collect()] == ["Runner", "start", "run_all"]
    assert rows(ingest.index_repository(spark, f"{tmp_path}/tree", out, ["run.zig"]))[0] == ("document", "zig", 1)


def test_decisions(spark):
    none = spark.createDataFrame([], "id long, title string, context string, decision string, status string, superseded_by long, created_at string")
    a = ops.decide(none, "one", "why", "do", "2024-01-01")
    b = ops.decide(a, "two", "", "do not", "2024-01-02", supersedes=1)
    assert [(r.id, r.title, r.status, r.superseded_by) for r in b.orderBy("id").collect()] == [(1, "one", "superseded", 2), (2, "two", "accepted", None)]
    assert ops.decision(b, 2).first().decision == "do not" and ops.decision(b, 9).collect() == []
    assert [r.title for r in ops.decisions(b, "accepted").collect()] == ["two"]
    with pytest.raises(ValueError):
        ops.decide(none, "", "", "x", "2024-01-01")


def test_context_of_a_question(spark):
    s = spark.createDataFrame([(1, 1, "runAll", "function", 1, 2), (2, 1, "start", "function", 4, 6), (3, 2, "main", "function", 1, 1)], "id long, document_id long, name string, kind string, line_start int, line_end int")
    e = spark.createDataFrame([(3, 1), (1, 2)], "src long, dst long").withColumns({"edge_type": F.lit("calls"), "confidence": F.lit(1.0)})
    d = spark.createDataFrame([(1, "src/run.zig"), (2, "main.zig")], "id long, path string")
    hits = spark.createDataFrame([(1, "src/run.zig", "fn runAll() {"), (2, "main.zig", "runAll();")], "doc_id long, path string, snippet string")
    text = context.build("Who calls runAll ?", hits, s, e, d, 400).first().markdown
    assert text.split("\n\n")[:4] == ["## src/run.zig", "fn runAll() {", "## main.zig", "runAll();"]
    assert "## Calls around runAll\n\nmain -> runAll\nrunAll -> start" in text and text.endswith("## Architecture\n\n2 files, 3 symbols, 2 edges\nsrc/: 1 files, 2 symbols\n.: 1 files, 1 symbols")
    few = context.build("nothing named", hits, s, e, d, 6).first().markdown
    assert few == "## src/run.zig\n\nfn runAll() {\n\n## main.zig\n\nrunAll();"[: len(few)] and "Calls" not in few
    assert "Architecture" in context.build("x", hits.limit(0), s, e.limit(0), d, 400).first().markdown


def test_neighbours_of_some_nodes_are_theirs_of_all(spark):
    e = spark.createDataFrame([(i % 7, (i * 5) % 11, "calls", (i % 10) / 10) for i in range(200)], "src long, dst long, edge_type string, confidence double").distinct()
    some = spark.createDataFrame([(2,), (3,), (3,), (99,)], "a long")
    for d in ("outbound", "inbound", "both"):
        assert rows(graph.neighbours(e, d, 4, some)) == [r for r in rows(graph.neighbours(e, d, 4)) if r[0] in (2, 3)]


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    assert config.load(path) == config.Config()
    config.save(config.Config(results=3, ignore=("*.md",)), path)
    assert config.load(path) == config.Config(results=3, ignore=("*.md",))
    path.write_text('{"b": 0.5, "unknown": 1}')
    assert config.load(path) == config.Config(b=0.5)
    with pytest.raises(ValueError):
        config.Config(results=0)
