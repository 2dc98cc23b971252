"""Operators on small fixtures with known answers: graph, text, tokens, maintenance, languages."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import code, nl, vectors
from corvane.functions.tokenize import emissions, is_identifier, query_terms, split_identifier
from corvane.operators import context, extract, graph, incremental, index, ops, search
from corvane.plans import cypher, sqlquery
from corvane.sources import files
from corvane.streaming import watcher


@pytest.fixture(scope="module")
def chain(spark):
    """main -> init -> parse -> validate -> parse."""
    s = spark.createDataFrame([(1, 1, "main", "function", 1, 3, None), (2, 1, "init", "function", 4, 6, None), (3, 2, "parse", "method", 1, 2, 1), (4, 2, "validate", "function", 3, 9, 1)], "id long, document_id long, name string, kind string, line_start int, line_end int, community_id long")
    e = spark.createDataFrame([(1, 2, "calls", 1.0), (2, 3, "calls", 0.9), (3, 4, "calls", 0.8), (4, 3, "calls", 0.5), (1, 3, "imports", 1.0)], "src long, dst long, edge_type string, confidence double")
    return s, e


@pytest.fixture(scope="module")
def arch(spark):
    names = [(1, 1, "main"), (2, 1, "init"), (3, 1, "handleRequest"), (4, 2, "parse"), (5, 2, "validate"), (6, 2, "format")]
    s = spark.createDataFrame([(*x, "function", 1, 2, None) for x in names], "id long, document_id long, name string, kind string, line_start int, line_end int, community_id long")
    pairs = [(1, 2, 1.0), (1, 3, 0.9), (4, 5, 0.8), (1, 4, 1.0), (2, 6, 0.7), (1, 5, 0.5), (3, 5, 0.6), (6, 5, 0.7)]
    return s, spark.createDataFrame([(a, b, "calls", c) for a, b, c in pairs], "src long, dst long, edge_type string, confidence double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_trace_and_cycle(chain):
    _, e = chain
    seen, met = graph.trace(e, 1, 10)
    assert rows(seen) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert met.count() == 4
    assert tuple(graph.revisited(met).first()) == (True, True)
    assert rows(graph.trace(e, 4, 1, "inbound")[0]) == [(3, 1), (4, 0)]
    assert rows(graph.trace(e, 3, 1, "both")[0]) == [(2, 1), (3, 0), (4, 1)]
    assert rows(graph.trace(e, 99, 3)[0]) == [(99, 0)]
    with pytest.raises(ValueError):
        graph.trace(e, 1, 0)


def test_a_diamond_is_no_cycle(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long").withColumn("edge_type", F.lit("calls")).withColumn("confidence", F.lit(1.0))
    assert tuple(graph.revisited(graph.trace(e, 1, 5)[1]).first()) == (True, False)


def test_trace_path(chain, spark):
    _, e = chain
    r = graph.trace_path(e, 1, 4, 5).first()
    assert (r.found, r.hops, r.path) == (True, 3, [1, 2, 3, 4]) and r.confidence == pytest.approx(0.72)
    assert tuple(graph.trace_path(e, 2, 2, 5).first()) == (True, 0, 1.0, [2])
    assert graph.trace_path(e, 4, 1, 5).first().found is False
    two = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (2, 4, 1.0), (3, 4, 0.9), (1, 5, 1.0), (5, 6, 1.0), (6, 4, 1.0)], "src long, dst long, confidence double").withColumn("edge_type", F.lit("calls"))
    assert graph.trace_path(two, 1, 4, 5).first().path == [1, 3, 4]


def test_neighbour_cap(spark):
    e = spark.createDataFrame([(1, i, "calls", (i % 7) / 10) for i in range(2, 130)], "src long, dst long, edge_type string, confidence double")
    want = sorted(((i % 7) / 10, -i) for i in range(2, 130))[-50:]
    assert sorted((r.confidence, -r.b) for r in graph.neighbours(e).collect()) == want


def test_architecture(arch, spark):
    s, e = arch
    d = spark.createDataFrame([(1, "src/main.zig"), (2, "util.zig")], "id long, path string")
    assert rows(graph.architecture(d, s, e)) == [(2, 6, 8)]
    assert rows(graph.modules(d, s)) == [(".", 1, 3), ("src/", 1, 3)]
    assert [r.name for r in graph.entry_points(s, e).collect()] == ["main"]
    assert graph.fan(s, e, "fan_in").first().name == "validate" and graph.fan(s, e, "fan_in").first().fan_in == 4
    assert graph.hotspots(s, e).count() == 6
    assert tuple(graph.coupling(s, e).first()) == (8, 4, 4, 0.5)
    assert tuple(graph.coupling(s, e.limit(0)).first()) == (0, 0, 0, 0.0)
    dangling = e.unionByName(spark.createDataFrame([(1, 77, "calls", 1.0)], e.schema))
    assert graph.coupling(s, dangling).first().external == 4


def test_communities(spark):
    a = [(i, j) for i in range(1, 6) for j in range(1, 6) if i != j] + [(i, j) for i in range(11, 16) for j in range(11, 16) if i != j] + [(5, 11)]
    e = spark.createDataFrame([(i, j, "calls", 1.0) for i, j in a], "src long, dst long, edge_type string, confidence double")
    n = spark.createDataFrame([(i,) for i in (*range(1, 6), *range(11, 16), 99)], "id long")
    got = graph.communities(n, e)
    by = {r.id: r.community for r in got.collect()}
    assert len({by[i] for i in range(1, 6)}) == 1 and len({by[i] for i in range(11, 16)}) == 1 and by[1] != by[11] and by[99] == 99
    q = graph.modularity(e, got.select("id", "community")).first()[0]
    assert q == pytest.approx(got.first().modularity) and 0 < q
    none = graph.communities(n, e.limit(0)).collect()
    assert all(r.community == r.id and r.modularity == 0 for r in none)


def test_communities_go_on_while_the_other_half_would_move(spark):
    late = [r.id for r in spark.range(200).where("pmod(xxhash64(id, 42), 2) = 1 AND pmod(xxhash64(id, 43), 2) = 1").orderBy("id").limit(2).collect()]  # move in neither of the first sweeps
    e = spark.createDataFrame([(*late, "calls", 1.0)], "src long, dst long, edge_type string, confidence double")
    got = graph.communities(spark.createDataFrame([(i,) for i in late], "id long"), e).collect()
    assert {r.community for r in got} == {min(late)}


def test_leiden_sweeps_as_often_as_the_operator(spark, data, monkeypatch):
    from corvane.plans import registry

    asked = {}
    monkeypatch.setattr(graph, "communities", lambda nodes, edges, **more: asked.update(more) or nodes)
    registry.QUERIES["leiden"](spark, data)
    assert asked.get("sweeps", 20) >= 20


def test_list_communities_and_search(chain):
    s, e = chain
    assert rows(graph.list_communities(s)) == [(1, 2, "parse,validate")]
    assert rows(graph.search_graph(s, e, "PARS")) == [(3, "parse", "method", 3, 1)]
    assert rows(graph.search_graph(s, e, "%i_i%")) == [(2, "init", "function", 1, 1)]
    assert graph.search_graph(s, e, "a", "module").isEmpty()


def test_signals(chain):
    s, e = chain
    assert rows(search.related(s, e, ["main"])) == [(1, 1.0), (2, 1.0)]
    assert rows(search.kind_boosts(s)) == [(1, 1.3), (2, 1.3)]
    assert rows(search.kind_boosts(s, ["parse"])) == [(2, 0.8)]
    assert search.lookup(s, "init").first().id == 2 and search.lookup(s, "none").isEmpty()


def test_tokens(spark):
    cases = {"userRepo": "user,Repo", "user_repo": "user,repo", "getUserById": "get,User,By,Id", "HTTP": "HTTP", "HTTPServer": "HTTP,Server", "XMLHttpRequest": "XML,Http,Request", "file123Name": "file123,Name", "foo_foo": "foo,foo", "__a__": "a", "The": "The"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("t", "want", F.array_join(split_identifier(F.col("t")), ",").alias("got"), emissions(F.col("t")).alias("e")).collect():
        assert r.got == r.want
        whole = r.t.replace("_", "").lower()
        assert r.e == [whole, *[p.lower() for p in r.want.split(",") if p.lower() != whole]]
    odd = spark.createDataFrame([("_",), ("a" * 300,), ("aB" * 20,)], "t string").select(emissions(F.col("t"))).collect()
    assert odd[0][0] == [] and odd[1][0] == ["a" * 256] and len(odd[2][0]) == 17
    assert query_terms("Foo_bar foo") == {"foo": 2, "bar": 1}
    ids = spark.createDataFrame([(x,) for x in ("camelCase", " snake_case ", "foo123", "how does", "", "12345", "foo.bar", "_")], "q string")
    assert [r[0] for r in ids.select(is_identifier(F.col("q"))).collect()] == [True, True, True, False, False, False, False, False]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(1, "src/auth", "fn authMiddleware does auth"), (2, "src/db", "databaseConnection\nconnects the database"), (3, "b/none", None), (4, "a/same", "twin words"), (5, "b/same", "twin words")], "doc_id long, path string, content string")


def test_bm25(corpus):
    i = index.build(corpus)
    assert [r.path for r in search.top(search.bm25(i, "auth middleware"), 5).collect()] == ["src/auth"]
    assert [r.path for r in search.top(search.bm25(i, "twin"), 5).collect()] == ["a/same", "b/same"]
    assert search.bm25(i, "unknown").isEmpty() and search.bm25(i, "").isEmpty()
    once, twice = search.bm25(i, "twin").first().score, search.bm25(i, "twin twin").first().score
    assert twice == pytest.approx(2 * once)
    assert {r.doc_id: r.token_count for r in i.docs.collect()} == {1: 6, 2: 6, 3: 0, 4: 2, 5: 2}
    assert search.bm25(index.build(corpus.limit(0)), "twin").isEmpty()


def test_symbol_boost(corpus, spark):
    i = index.build(corpus, spark.createDataFrame([(1, "authMiddleware"), (4, "twin")], "doc_id long, name string"))
    assert {(r.term, r.doc_id): (r.tf, r.first_pos) for r in i.postings(["twin", "auth"]).collect()} == {("twin", 4): (2, 0), ("twin", 5): (1, 0), ("auth", 1): (3, 0)}


def test_segments_and_overlay(corpus, spark, tmp_path):
    root = f"file://{tmp_path}/p"
    index.write_segment(index.build(corpus), root)
    assert [r.path for r in search.top(search.bm25(index.open_segment(spark, root), "twin"), 5).collect()] == ["a/same", "b/same"]
    new = spark.createDataFrame([(9, "src/auth", "bananaToken")], corpus.schema)
    dead = spark.createDataFrame([("src/auth",), ("a/same",)], "path string")
    index.write_segment(index.build(search.with_overlay(corpus, new, dead)), root)
    seg = index.open_segment(spark, root)
    assert search.bm25(seg, "auth").isEmpty()
    assert [r.doc_id for r in search.bm25(seg, "banana").collect()] == [9]
    assert [r.path for r in search.bm25(seg, "twin").collect()] == ["b/same"]


def test_snippet(corpus):
    r = search.search(index.build(corpus), corpus, "database", 1).first()
    assert r.snippet.startswith("databaseConnection") and r.doc_id == 2


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0, 3.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 1.0]
    t = spark.createDataFrame([(1, "abc abc"), (2, "abc"), (3, "xy"), (4, "")], "id long, t string")
    e = vectors.embed_text(t, "id", "t")
    assert {r.id for r in e.collect()} == {1, 2} and e.where("id = 1").first().weight == pytest.approx(1.0)
    assert len(vectors.dense(e).first().vector) == vectors.DIM
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "doc_id long, vector array<double>")
    assert [r.doc_id for r in search.semantic(v, v.where("doc_id = 1")).collect()] == [1]
    both = vectors.embed_document([e.where("id = 1"), vectors.embed_text(t.where("id = 2").withColumn("t", F.lit("defgh")), "id", "t").withColumn("id", F.lit(1).cast("long"))])
    assert both.agg(F.sum(F.col("weight") * F.col("weight"))).first()[0] == pytest.approx(1.0)


def test_semantic_takes_every_query(spark):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 6)]) for i in range(40)]
    rows += [(40, rows[3][1]), (41, [0.0] * 5), (42, None), (43, []), (44, [1.0, None, 2.0]), (45, [3.0, 1.0]), (None, rows[5][1]), (46, [float("nan")] * 5)]
    v = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    asked = v.where("doc_id % 4 = 0 OR doc_id IN (45, 46)").select(F.col("doc_id").alias("query_id"), "vector")
    plain = v.crossJoin(asked.withColumnRenamed("vector", "q")).select("query_id", "doc_id", vectors.cosine(F.col("vector"), F.col("q")).alias("s")).where("s > 0").collect()
    as_set = lambda rows: sorted(repr(tuple(r)) for r in rows)
    for block in (100, 3):
        got = search.semantic_each(v, asked, block=block)
        assert as_set(got.collect()) == as_set(plain) and len({r.query_id for r in plain}) > 8
        key = lambda r: (r.s == r.s, -r.s if r.s == r.s else 0, r.doc_id is not None, r.doc_id)
        want = [r for q in {r.query_id for r in plain} for r in sorted((x for x in plain if x.query_id == q), key=key)[:3]]
        assert as_set(search.semantic_each(v, asked, 3, block).collect()) == as_set(want)
    assert search.semantic_each(v, asked.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="takes one query"):
        search.semantic(v, asked).collect()


def test_hybrid(spark):
    lex = spark.createDataFrame([(1, 3.0), (2, 2.0)], "doc_id long, score double")
    sim = spark.createDataFrame([(2, 0.9), (3, 0.5)], "doc_id long, similarity double")
    got = {r.doc_id: r for r in search.hybrid_search(lex, sim, "two words", 5).collect()}
    assert got[2].fused == pytest.approx(1 / 62 + 1 / 61) and got[1].semantic == 0 and got[3].bm25 == 0
    assert {r.doc_id for r in search.hybrid_search(lex, sim, "oneWord", 5).collect()} == {1, 2}


def test_cypher(chain):
    s, e = chain
    run = lambda q: [tuple(r) for r in cypher.run(q, s, e).collect()]
    assert cypher.is_cypher(" match (a)") and not cypher.is_cypher("SELECT 1")
    assert run("MATCH (a)-[:CALLS]->(b) RETURN a.name, b ORDER BY a.id, b.id") == [("main", "init"), ("init", "parse"), ("parse", "validate"), ("validate", "parse")]
    assert run("MATCH (a:Method)<-[r:calls]-(b) RETURN b.name AS n, r.confidence AS c ORDER BY c DESC") == [("init", 0.9), ("validate", 0.5)]
    assert run("MATCH (a)-[:IMPORTS]->(b) RETURN a, b") == [("main", "parse")]
    assert run("MATCH (a)-[:CALLS]->(b) MATCH (b)-[:CALLS]->(c) WHERE NOT a.name = 'x' AND c.name <> 'main' RETURN a, c ORDER BY a.id LIMIT 2") == [("main", "parse"), ("init", "validate")]
    assert run("MATCH (a)->(b) WHERE a.id = 1 OR a.id = 2 AND b.id = 9 RETURN b.id") == [(2,)]
    for bad in ("MATCH (a RETURN a", "MATCH (a) RETURN b", "MATCH (a) RETURN a.nothing", "RETURN 1", "MATCH (a) RETURN a LIMIT x", "MATCH (a) RETURN a, a"):
        with pytest.raises(cypher.SyntaxFault):
            cypher.run(bad, s, e)


def test_sql_guard(chain, spark):
    s, _ = chain
    assert sqlquery.run(spark, "WITH x AS (SELECT 1 AS n) SELECT * FROM x;", {}).collect()[0].n == 1
    assert sqlquery.run(spark, "select * from symbols limit 2", {"symbols": s}).count() == 2
    assert sqlquery.run(spark, "SELECT id FROM range(1000)", {}, 5000).count() == sqlquery.MOST
    for bad in ("DROP TABLE symbols", "SEL", "", "SELECTED", "INSERT INTO symbols SELECT 1"):
        with pytest.raises(ValueError):
            sqlquery.run(spark, bad, {"symbols": s})


def test_extraction(spark):
    text = 'const std = @import("std");\npub const Pool = struct {\n    pub fn take(self: *Pool) void {\n        check(self);\n    }\n};\nfn check(p: *Pool) void {}\nvar count: u32 = 0;'
    d = spark.createDataFrame([(1, "zig", text), (2, "python", "def f(): pass"), (3, "zig", None)], "doc_id long, language string, content string")
    got = {(r.kind, r.source, r.target) for r in extract.extract(d).collect()}
    assert {("struct_type", None, "Pool"), ("method", None, "take"), ("contains", "Pool", "take"), ("calls", "take", "check"), ("function", None, "check"), ("variable", None, "count"), ("imports", "(file)", "std")} <= got
    lines = {(r.line, r.kind, r.name) for r in extract.parse_lines(d, "doc_id", "content").collect()}
    assert lines == {(0, "const_value", "std"), (1, "struct_type", "Pool"), (2, "function", "take"), (6, "function", "check"), (7, "variable", "count")}


def test_routes(spark):
    code_lines = ["app.get('/a', f)", 'router.post( "/b")', "@app.route('/c')", '@router.put("/d")', 'mux.HandleFunc("/e", h)', '#[get("/f")]', "Route::any('/g', x)", "no route", "app.get('" + "x" * 300 + "')"]
    got = {(r.doc_id, r.route) for r in extract.routes(spark.createDataFrame(list(enumerate(code_lines)), "id long, t string"), "id", "t").collect()}
    assert got == {(i, "/" + c) for i, c in enumerate("abcdefg")}


def test_resolution(chain, spark):
    s, _ = chain
    x = spark.createDataFrame([("main", "parse", "calls", 1.0), ("main", "nobody", "calls", 1.0)], "source string, target string, edge_type string, confidence double")
    assert rows(extract.resolve(x, s)) == [(1, 3, "calls", 1.0)]


def test_incremental(chain, spark):
    s, e = chain
    cur = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "path string, mtime long")
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 12345)], "path string, mtime long")
    assert rows(incremental.diff(cur, old)) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    assert rows(incremental.diff(cur, cur)) == [] and incremental.diff(cur, old.limit(0)).where("change = 'added'").count() == 3
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    changes = spark.createDataFrame([("b", "deleted")], "path string, change string")
    d2, s2, e2 = incremental.apply(d, s, e, changes, d.limit(0), s.limit(0), e.limit(0))
    assert rows(d2) == [(1, "a")] and s2.count() == 2 and rows(e2) == [(1, 2, "calls", 1.0)]
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "3")], "path string, hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "0"), ("g", "4")], "path string, hash string")
    new, dead = incremental.overlay(c, b)
    assert rows(new.select("path")) == [("b",), ("n",)] and rows(dead) == [("b",), ("g",)]
    assert rows(incremental.upsert(b, c, "path")) == [("a", "1"), ("b", "2"), ("g", "4"), ("n", "3")]


def test_ops(spark):
    t = spark.createDataFrame([(1, "foo my_foo foo.bar food foo"), (2, "none")], "doc_id long, content string")
    assert rows(ops.rename_preview(t, "foo", "b$r").select("doc_id", "occurrences")) == [(1, 3)]
    assert t.select(ops.rename(F.col("content"), "foo", "b$r")).first()[0] == "b$r my_foo b$r.bar food b$r"
    ev = spark.createDataFrame([(1, 1, 7, "a", '{"k": 2}'), (2, 2, 7, "b", '{"k": 3}'), (3, 3, 7, "a", "bad"), (4, 1, 8, "b", None)], "event_id long, ts long, user_id long, event_type string, props string")
    assert rows(ops.trace_edges(ev).fillna(-1)) == [("a", "b", 1, 3), ("b", "a", 1, -1)]


def test_packing(spark):
    s = spark.createDataFrame([(5, 1, "b", "y" * 200), (10, 2, "a", "x" * 200), (1, 3, "c", "z" * 200)], "priority int, pos int, title string, content string")
    assert rows(context.pack(s, 100).select("title", "tokens")) == [("a", 50), ("b", 50)]
    assert rows(context.pack(s, 120, 10).select("title", "tokens")) == [("a", 50), ("b", 50), ("c", 10)]
    assert context.pack(s, 10, 10).isEmpty()
    assert context.markdown(context.pack(s, 60)).first()[0] == "## a\n\n" + "x" * 200 + "\n\n## b\n\n" + "y" * 40
    one = spark.createDataFrame([("hello",), ("café",), ("",), (None,)], "t string").select(code.estimate_tokens(F.col("t"))).collect()
    assert [r[0] for r in one] == [2, 2, 0, 0]


def test_questions(spark):
    want = {"where is the parser defined": "find_definition", "how is x defined": "explain", "who calls init": "find_usage", "explain this": "explain", "refactor the pool": "refactor", "there is a bug in it": "debug", "give an overview": "explore", "parse files": "search", None: "search"}
    df = spark.createDataFrame([(q,) for q in want], "q string")
    assert [r[0] for r in df.select(nl.intent(F.col("q"))).collect()] == list(want.values())
    q = spark.createDataFrame([("Find top 10 parseFile in javascript, in module core.x, *.zig and foo_bar The",)], "q string")
    assert {(c.kind, c.value) for c in q.select(nl.constraints(F.col("q"))).first()[0]} == {("language", "javascript"), ("module", "core"), ("file_pattern", "*.zig"), ("max_results", "10")}
    assert q.select(nl.symbols(F.col("q"))).first()[0] == ["parseFile", "foo_bar"]
    assert q.select(nl.tools(F.lit("debug"))).first()[0] == ["search_code", "trace_call_path", "get_code_snippet"]


def test_complexity_and_summary(spark):
    src = "fn f() {\n  // note\n  if (a) {\n    g(a);\n  }\n}\n}}\nelse\n"
    df = spark.createDataFrame([(1, "f", "function", src), (2, "g", "function", "")], "id long, name string, kind string, code string")
    got = {r.id: r for r in df.select("id", code.code_lines(F.col("code")).alias("n"), code.branches(F.col("code")).alias("b"), code.depth(F.col("code")).alias("d")).collect()}
    assert (got[1].n, got[1].b, got[1].d) == (8, 2, 2) and (got[2].n, got[2].b, got[2].d) == (0, 0, 0)
    r = {x.id: x for x in context.summarize(df).collect()}
    assert r[1].signature == "fn f()" and r[1].operations == ["g"] and r[1].purpose == "note" and r[1].complexity == pytest.approx(0.8 + 1.0 + 0.6)


def test_files(spark, tmp_path):
    for name, text in (("src/a.zig", "const x = 1;"), ("src/b.o", "x"), ("keep.md", "k"), ("node_modules/c.js", "n"), ("docs/d.md", "d")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r.path.split(tmp_path.name + "/")[1]: (r.content, r.language) for r in files.contents(spark, str(tmp_path), ["*.md", "!keep.md"]).collect()}
    assert got == {"src/a.zig": ("const x = 1;", "zig"), "keep.md": ("k", None)}
    assert files.metadata(spark, str(tmp_path)).count() == 5


@pytest.mark.parametrize("rule, path, hit", [("*.o", "a/b.o", True), ("*.o", "b.obj", False), ("src/**/test", "src/a/b/test/x", True), ("src/**/test", "src/test", True), ("file.??", "file.rs", True), ("file.??", "file.zig", False), ("build/", "x/build/y", True), ("/top", "top", True)])
def test_globs(spark, rule, path, hit):
    assert spark.range(1).select(code.ignored(F.lit(path), [rule])).first()[0] is hit


def test_watch(spark, tmp_path):
    root, seen = f"file://{tmp_path}", []
    for n, snapshot in enumerate(([("a", 1), ("b", 1)], [("a", 2), ("c", 1)])):
        spark.createDataFrame(snapshot, "path string, mtime long").coalesce(1).write.parquet(f"{root}/in/{n}")
        stream = spark.readStream.schema("path string, mtime long").option("recursiveFileLookup", True).parquet(f"{root}/in")
        watcher.watch(stream, f"{root}/state", lambda d, k: seen.append(rows(d)), f"{root}/check", once=True).awaitTermination()
    assert seen == [[("a", "added"), ("b", "added")], [("a", "modified"), ("b", "deleted"), ("c", "added")]]


def test_streaming_windows(spark, tmp_path):
    ev = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", i % 2, "a", 1.0) for i in range(0, 60, 5)], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sum(r.n for r in watcher.windowed(ev, "30 minutes").collect()) == 12 and watcher.windowed(ev, "30 minutes").count() == 2
    ev.write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(ev.schema).parquet(f"file://{tmp_path}/e")
    q = watcher.windowed(stream, "30 minutes").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("SELECT n FROM w")) == [(6,), (6,)]
    assert watcher.sessions(ev, "20 minutes").count() == 2
