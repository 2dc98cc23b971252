"""Graph operators over symbols (id, ..) and edges (src, dst, edge_type, confidence). Nodes are ids.

Iterations advance a whole frontier by one join and are cut with written tables where a
shared folder is configured, so plans stay short and lost executors recompute one step.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window, functions as F

from corvane.operators import leiden
from corvane.sources.store import stored

NEIGHBOURS = 50
#: nodes of a frontier that are broadcast to the edges; a larger one is joined by a shuffle, which nodes / FRONTIER depths of a trace need at most
FRONTIER = 1 << 20


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the session's shared folder; without one, in local mode, with a table in a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            return stored(df, "graph")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def neighbours(edges: DataFrame, direction: str = "outbound", most: int = NEIGHBOURS, of: DataFrame | None = None) -> DataFrame:
    """(a, b, confidence, direction): each node's best ``most`` neighbours by confidence, then id; of the nodes ``of`` (a) alone, if they are given.

    The nodes asked for are joined first, so only their edges are ranked. A node's rank needs its edges in order; hot nodes are first cut to ``most`` within each
    of their salts, which drops only edges that the rank would drop as well.
    """
    e = edges.where(F.col("edge_type") == "calls")
    end = lambda a, b, d: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(d).alias("direction"))
    ends = {"outbound": [end("src", "dst", "outbound")], "inbound": [end("dst", "src", "inbound")]}
    ends["both"] = ends["outbound"] + ends["inbound"]
    both = e.select("confidence", F.explode(F.array(*ends[direction])).alias("e")).select("e.a", "e.b", "confidence", "e.direction")
    if of is not None:
        both = both.join(of, "a", "left_semi")
    best = lambda *k: F.row_number().over(Window.partitionBy("direction", "a", *k).orderBy(F.desc("confidence"), "b"))
    salted = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(16)))
    return salted.withColumn("r", best("salt")).where(F.col("r") <= most).withColumn("r", best()).where(F.col("r") <= most).select("a", "b", "confidence", "direction")


def trace(edges: DataFrame, start: int, depth: int, direction: str = "outbound") -> tuple[DataFrame, DataFrame]:
    """Breadth-first from a node: (id, depth) of all nodes within ``depth``, and the edges met while expanding, (a, b, confidence, direction, depth).

    edges should be a stored table: each depth reads it once, until one meets no new node. A frontier of up to FRONTIER nodes is broadcast,
    so of the edges only its own are shuffled, and no node is expanded twice.
    """
    if depth < 1:
        raise ValueError("depth is at least 1")
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id long, depth int")
    frontier, met, size = seen, None, 1
    for d in range(1, depth + 1):
        of = frontier.select(F.col("id").alias("a"))
        part = cut(neighbours(edges, direction, of=F.broadcast(of) if size <= FRONTIER else of).withColumn("depth", F.lit(d - 1)))
        met = part if met is None else met.unionByName(part)
        frontier = part.select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(d))
        if d < depth:
            frontier = cut(frontier)
            size = frontier.count()
            if not size:
                break
        seen = seen.unionByName(frontier)
    return seen, met


def revisited(met: DataFrame) -> DataFrame:
    """One row (revisited, has_cycle): whether some node was met twice, and whether an edge leads back to an ancestor or the same depth's loop, that is a cycle of the traced part."""
    twice = met.groupBy("b").count().where("count > 1")
    e = met.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return met.sparkSession.range(1).select(F.lit(not twice.isEmpty()).alias("revisited"), F.lit(has_cycle(e)).alias("has_cycle"))


def has_cycle(edges: DataFrame) -> bool:
    """Peels nodes without edges in or out until nothing changes; what is left has a cycle."""
    left, n = edges, None
    while (m := left.count()) and m != n:
        n = m
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    return m > 0


def trace_path(edges: DataFrame, source: int, target: int, depth: int) -> DataFrame:
    """One row (found, hops, confidence, path): of the shortest directed paths within ``depth`` the one with the highest product of confidences (to 9 digits), then the least ids.

    Each layer keeps one path for a node, the best, found by a partial aggregate.
    """
    spark = edges.sparkSession
    schema = "found boolean, hops int, confidence double, path array<bigint>"
    if source == target:
        return spark.createDataFrame([(True, 0, 1.0, [source])], schema)
    e = edges.where(F.col("edge_type") == "calls").select(F.col("src").alias("id"), F.col("dst").alias("to"), F.col("confidence").alias("c"))
    layer = spark.createDataFrame([(source, 1.0, [source])], "id long, confidence double, path array<bigint>")
    seen = layer.select("id")
    for d in range(1, depth + 1):
        step = layer.join(e, "id").select(F.col("to").alias("id"), (F.col("confidence") * F.col("c")).alias("confidence"), F.concat("path", F.array("to")).alias("path"))
        best = step.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct((-F.round("confidence", 9)).alias("k"), "path", "confidence")).alias("b"))
        layer = cut(best.select("id", "b.confidence", "b.path"))
        hit = layer.where(F.col("id") == target)
        if not hit.isEmpty():
            return hit.select(F.lit(True).alias("found"), F.lit(d).alias("hops"), "confidence", "path")
        seen = seen.unionByName(layer.select("id"))
    return spark.createDataFrame([(False, None, 0.0, [])], schema)


def degrees(symbols: DataFrame, edges: DataFrame, calls: bool = True) -> DataFrame:
    """symbols with fan_in and fan_out, each from a partial aggregate."""
    e = edges.where(F.col("edge_type") == "calls") if calls else edges
    return symbols.join(e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in")), "id", "left").join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out")), "id", "left").fillna(0, ["fan_in", "fan_out"])


def centrality(symbols: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    return degrees(symbols, edges).withColumn("degree", F.col("fan_in") + F.col("fan_out")).where("degree > 0").orderBy(F.desc("degree"), "id").limit(k)


def modularity(edges: DataFrame, communities: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row (modularity): over existing edges inside a community (id, community), w - gamma * d_i * d_j / 2m, by 2m; d is the weight of edges out."""
    e = edges.select("src", "dst", F.col("confidence").alias("w"))
    d = e.groupBy("src").agg(F.sum("w").alias("d"))
    m = e.agg(F.sum("w").alias("m"))
    side = communities.join(d.withColumnRenamed("src", "id"), "id", "left").select("id", "community", F.coalesce("d", F.lit(0.0)).alias("d"))
    x = e.join(side.select(F.col("id").alias("src"), F.col("community").alias("cs"), F.col("d").alias("ds")), "src").join(side.select(F.col("id").alias("dst"), F.col("community").alias("ct"), F.col("d").alias("dt")), "dst")
    q = F.sum(F.when(F.col("cs") == F.col("ct"), F.col("w") - gamma * F.col("ds") * F.col("dt") / (2 * F.col("m"))).otherwise(0.0)) / (2 * F.first("m"))
    return x.crossJoin(F.broadcast(m)).agg(F.coalesce(q, F.lit(0.0)).alias("modularity"))


def communities(nodes: DataFrame, edges: DataFrame, sweeps: int = 20, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, community, modularity): local moving with refinement, deterministic.

    Sweeps are synchronous: in each, a seeded half of the nodes moves to the neighbouring
    community of the highest gain ``k_in / m - gamma * d * W / 2m^2``, if that is above 0 and above the own.
    They end when no node of either half would move.
    A community whose inner weight doesn't exceed its outer is then split into single nodes. Ids
    are renumbered by their least member. Sweeps run over blocks of nodes (``leiden``); where a hot node's
    edges are too many for one task, every step is aggregates and joins on node or community.
    """
    e = stored(edges.select("src", "dst", F.col("confidence").alias("w")))
    m = e.agg(F.sum("w")).first()[0]
    if not m:
        return nodes.select("id", F.col("id").alias("community"), F.lit(0.0).alias("modularity"))
    found = leiden.moved(nodes, e, m, sweeps, gamma, seed)
    if found:
        part, keep = found
    else:
        both = stored(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
        part = _moved(nodes, both, m, sweeps, gamma, seed)
        inner = both.join(part.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(part.select(F.col("id").alias("dst"), F.col("c").alias("ct")), "dst")
        keep = inner.groupBy(F.col("cs").alias("c")).agg(F.sum(F.when(F.col("cs") == F.col("ct"), F.col("w")).otherwise(0.0)).alias("i"), F.sum(F.when(F.col("cs") != F.col("ct"), F.col("w")).otherwise(0.0)).alias("o"))
    refined = part.join(keep.select("c", "i", "o"), "c", "left").select("id", F.when(F.coalesce(F.col("i") > F.col("o"), F.lit(False)), F.col("c")).otherwise(F.col("id") + F.lit(1 << 60)).alias("c"))
    named = refined.join(refined.groupBy("c").agg(F.min("id").alias("community")), "c").select("id", "community")
    if not found:
        return named.crossJoin(F.broadcast(modularity(edges, named, gamma)))
    inside = F.sum(F.when(F.col("i") > F.col("o"), F.col("inner")).otherwise(F.col("loops"))) / (4 * m)
    return named.crossJoin(F.broadcast(keep.agg(F.coalesce(inside, F.lit(0.0)).alias("modularity"))))


def _moved(nodes: DataFrame, both: DataFrame, m: float, sweeps: int, gamma: float, seed: int) -> DataFrame:
    """(id, c) after the sweeps, by joins alone; no group is gathered."""
    d = stored(nodes.select("id").join(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")), "id", "left").fillna(0.0, ["d"]))
    part = stored(nodes.select("id", F.col("id").alias("c")))
    for sweep in range(sweeps):
        sized = part.join(d, "id").groupBy("c").agg(F.sum("d").alias("W"))
        to = both.join(part.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("k"))
        gain = to.join(sized, "c").join(d, "id").join(part.withColumnRenamed("c", "own"), "id")
        rest = F.col("W") - F.when(F.col("c") == F.col("own"), F.col("d")).otherwise(0.0)
        gain = gain.withColumn("g", F.round(F.col("k") / m - gamma * F.col("d") * rest / (2 * m * m), 12))
        pick = gain.groupBy("id").agg(F.max(F.struct("g", (F.col("c") == F.col("own")).alias("stay"), (-F.col("c")).alias("c"))).alias("b"))
        moves = (F.col("b.g") > 0) & (F.pmod(F.xxhash64("id", F.lit(seed + sweep)), F.lit(2)) == 0)
        wish = F.coalesce((F.col("b.g") > 0) & ~F.col("b.stay"), F.lit(False))
        new = stored(part.join(pick, "id", "left").select("id", F.when(moves, -F.col("b.c")).otherwise(F.col("c")).alias("c"), wish.alias("wish")))
        part = new.select("id", "c")
        if new.where("wish").isEmpty():
            break
    return part


def list_communities(symbols: DataFrame, k: int = 20, members: int = 5) -> DataFrame:
    """The largest communities with their first members by name. Members are ranked within tasks' salts before the last rank, so a huge community is never gathered."""
    s = symbols.where("community_id IS NOT NULL")
    top = s.groupBy("community_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community_id").limit(k)
    order = lambda *p: F.row_number().over(Window.partitionBy("community_id", *p).orderBy("name", "id"))
    few = s.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("r", order("salt")).where(F.col("r") <= members).withColumn("r", order()).where(F.col("r") <= members)
    named = few.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("sample"))
    return top.join(named, "community_id").select("community_id", "size", "sample")


def architecture(documents: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return functools.reduce(lambda a, b: a.crossJoin(b), [one(documents, "files"), one(symbols, "symbols"), one(edges, "edges")])


def modules(documents: DataFrame, symbols: DataFrame, k: int = 20) -> DataFrame:
    """(module, files, symbols): directories, with their slash, by number of symbols. Symbols are counted by document before the join."""
    n = symbols.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("s"))
    module = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*/)", 1)).otherwise(".")
    return documents.join(n, "id", "left").groupBy(module.alias("module")).agg(F.count("*").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("symbols")).orderBy(F.desc("symbols"), "module").limit(k)


def entry_points(symbols: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """Functions and methods that nothing calls."""
    called = edges.where(F.col("edge_type") == "calls").select(F.col("dst").alias("id"))
    return symbols.where(F.col("kind").isin("function", "method")).join(called, "id", "left_anti").orderBy("name", "id").limit(k)


def fan(symbols: DataFrame, edges: DataFrame, side: str, k: int = 10) -> DataFrame:
    """Symbols by fan_out or fan_in."""
    return degrees(symbols, edges).where(F.col(side) > 0).orderBy(F.desc(side), "id").limit(k).select("id", "name", side)


def hotspots(symbols: DataFrame, edges: DataFrame, k: int = 50) -> DataFrame:
    return centrality(symbols, edges, k).select("id", "name", "kind", "fan_in", "fan_out", F.col("degree").alias("total"))


def coupling(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (total, external, internal, ratio) of calls; an edge with an unknown end counts in the total alone."""
    e = edges.where(F.col("edge_type") == "calls")
    doc = lambda end: symbols.select(F.col("id").alias(end), F.col("document_id").alias(f"{end}_doc"))
    x = e.join(doc("src"), "src", "left").join(doc("dst"), "dst", "left")
    n = x.agg(F.count("*").alias("total"), F.coalesce(F.sum((F.col("src_doc") != F.col("dst_doc")).cast("long")), F.lit(0)).alias("external"))
    return n.select("total", "external", (F.col("total") - F.col("external")).alias("internal"), F.coalesce(F.try_divide(F.col("external").cast("double"), F.col("total")), F.lit(0.0)).alias("ratio"))


def search_graph(symbols: DataFrame, edges: DataFrame, pattern: str, kind: str | None = None, k: int = 20) -> DataFrame:
    """Symbols by name (anywhere in it unless the pattern has a wildcard; any case), with degrees over all edge types."""
    if "%" not in pattern and "_" not in pattern:
        pattern = f"%{pattern}%"
    s = symbols.where(F.col("name").ilike(pattern.replace("\\", "\\\\")))
    if kind:
        s = s.where(F.col("kind") == kind)
    s = s.orderBy("name", "id").limit(min(k, 100))
    e = edges.join(F.broadcast(s.select(F.col("id").alias("src"))), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    i = edges.join(F.broadcast(s.select(F.col("id").alias("dst"))), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return s.join(e, "id", "left").join(i, "id", "left").fillna(0, ["out_degree", "in_degree"]).select("id", "name", "kind", "in_degree", "out_degree")


def code_snippet(symbols: DataFrame, documents: DataFrame, name: str, context: int = 5) -> DataFrame:
    """Lines around the first symbol of exactly this name; documents are (document_id, content)."""
    s = symbols.where(F.col("name") == name).orderBy("id").limit(1)
    lines = F.split("content", "\n", -1)
    lo = F.greatest(F.lit(1), F.col("line_start") - context)
    return documents.join(F.broadcast(s), "document_id").select("id", "name", lo.alias("first_line"), F.array_join(F.slice(lines, lo, F.col("line_end") + context - lo + 1), "\n").alias("code"))
