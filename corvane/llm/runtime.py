"""Shared-folder tables and connected components for the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.sources.store import shared_dir

def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors, never computes df twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain(docs: DataFrame, needed: list[str], made: list[str] = (), keep: list[str] | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the ``needed`` columns under these names and every other one under a name that clashes with nothing, and a function that gives an operator's result the old names again.

    Names are compared as Spark does, in any case, but a needed column of exactly its name is preferred. Of the others those that are named like a result (``made``)
    are left out, and all that aren't in ``keep``, if it is given. Columns of the same name are kept apart by their place. A needed column that is missing is a ValueError.
    """
    cols = docs.columns
    at = {}
    for n in needed:
        i = next((i for i, c in enumerate(cols) if c == n), next((i for i, c in enumerate(cols) if c.lower() == n.lower()), None))
        if i is None:
            raise ValueError(f"no column {n}")
        at[i] = n
    names = [at.get(i, f"x{i}_") for i in range(len(cols))]
    gone = {m.lower() for m in made}
    chosen = [n for i, (n, c) in enumerate(zip(names, cols)) if i in at or (c.lower() not in gone and (keep is None or c in keep))]
    old = dict(zip(names, cols))
    return docs.toDF(*names).select(*chosen), lambda out: out.toDF(*[old.get(c, c) for c in out.columns])


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOT_SHARE = 4096
HOT_ROWS = 100_000


def hot_join(big: DataFrame, small: DataFrame, key: str, n: str, total: int, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """big joined with small, whose ``key`` is unique and whose column ``n`` says how many of big's ``total`` rows have it. Keys with more than a ``HOT_SHARE``-th of the rows are fewer than ``HOT_SHARE``, so they are broadcast; the others are joined by a shuffle, where none can be large. Both should be written tables, as both are read twice where there is a hot key."""
    hot = small.where(F.col(n) > max(hot_rows, total // HOT_SHARE))
    if hot.isEmpty():
        return big.join(small, key, how)
    cold = small.where(F.col(n) <= max(hot_rows, total // HOT_SHARE))
    # null keys stay with the cold ones
    return big.join(F.broadcast(hot), key).unionByName(big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))


LOCAL_EDGES = 1 << 19


def _one_task(batches):
    """Components of at most LOCAL_EDGES edges (u, v)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for k in (i, j, label[i], label[j]):
            np.minimum.at(new, k, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", hot_rows: int = HOT_ROWS, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component): for every id of an edge the least id reachable. Alternates large-star and small-star steps until the edges are a forest of stars; every step is written to the shared folder.

    Edges that are counted and found to be at most ``local_edges`` (8 MB) are joined up in one task, with the same result.

    Hot ids: an id's least neighbour is a partial aggregate, and its fan-out goes through hot_join(); what a star holds is one row a member, so no group is collected. Null ends and loops are dropped. No edges give no rows.
    """
    e = table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    if e.count() <= local_edges:
        return table(e.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_one_task, "id long, component long"), "components")
    while True:
        total = 2 * e.count()
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "low")
        large = table(hot_join(both.where(F.col("v") > F.col("u")), low, "u", "n", total, hot_rows=hot_rows).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: u and its smaller neighbours go to the least of them
        down = table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "down")
        e = table(hot_join(large, down, "u", "n", total, hot_rows=hot_rows).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # done once no centre is a member and no member has two centres
        ends = e.select("u").union(e.select(F.col("v").alias("u")).distinct())
        if ends.groupBy("u").count().where("count > 1").isEmpty():
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
