"""Local moving over blocks of nodes against the same by joins."""

import random

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import graph, leiden


def test_xxhash64_is_sparks(spark):
    ids = np.array([0, 1, -1, 5, 1 << 60, -(1 << 63), 123456789], np.int64)
    df = spark.createDataFrame([(int(i),) for i in ids], "id long")
    got = df.select(F.xxhash64("id"), F.xxhash64("id", F.lit(47))).collect()
    assert [r[0] for r in got] == leiden.xxhash64(ids).view(np.int64).tolist()
    assert [r[1] for r in got] == leiden.xxhash64(ids, 47).view(np.int64).tolist()


def test_blocks_find_what_joins_find(spark, monkeypatch):
    r = random.Random(3)
    pairs = {(a, r.randrange(120) if r.random() < 0.2 else a // 12 * 12 + r.randrange(12)) for a in (r.randrange(120) for _ in range(500))}
    e = spark.createDataFrame([(a * 7 - 3, b * 7 - 3, "calls", r.choice([0.9, 0.95, 1.0])) for a, b in pairs], "src long, dst long, edge_type string, confidence double")
    nodes = spark.createDataFrame([(i * 7 - 3,) for i in range(125) if i % 17], "id long")  # some ends are no nodes, some nodes have no edges, some edges are loops
    joins = []
    monkeypatch.setattr(graph, "_moved", lambda *a, own=graph._moved: joins.append(1) or own(*a))

    def found():
        rows = graph.communities(nodes, e, sweeps=3).collect()
        return {x.id: x.community for x in rows}, round(rows[0].modularity, 12), len(rows)

    monkeypatch.setattr(leiden, "ENDS", 200)
    blocks = found()
    assert not joins and 1 < len(set(blocks[0].values())) < 117
    monkeypatch.setattr(leiden, "SKEW", 0)  # as with a hot node
    assert found() == blocks and joins
