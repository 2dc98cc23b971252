"""Local moving over blocks of nodes: each block holds its nodes' edges as arrays, and a sweep sends between blocks only what changes with it.

A block's rows are (block, kind, other, data), data being pickled arrays:
S its nodes (id, community, weight of edges, weight of edges out, weight of the community), other: whether a node would move;
A its edges (node, place among the other ends, weight or its code and the weights) by node, and those that are loops; R the nodes whose state block ``other`` asks for;
M that state; P partial weights of communities, sent to the block of the community's id, and V the sums it answers.
What is sent in a sweep is at most one entry for each end of an edge, in as many rows as there are pairs of blocks.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.sources.store import shared_dir, stored

#: ends of edges in a block, on average; a task holds one block, about 100 bytes an end
ENDS = 1 << 20
#: edges that a task packs at once
PACKED = 1 << 20
#: a block with so many times ENDS has a hot node
SKEW = 4
ROW = "block int, kind string, other int, data binary"
#: community of a node that isn't among the nodes
NONE = int(np.iinfo(np.int64).min)

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxhash64(ids: np.ndarray, more: int | None = None) -> np.ndarray:
    """Spark's xxhash64 of longs, or of longs and an int that isn't negative, unsigned."""
    k = _turn(ids.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
    h = _mix(_turn((_P5 + np.uint64(50)) ^ k, 27) * _P1 + _P4)
    if more is not None:
        h = _mix(_turn((h + _P5 + np.uint64(4)) ^ (np.full(1, more, np.uint64) * _P1), 23) * _P2 + _P3)
    return h


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (((xxhash64(ids) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def _rows(rows: list[tuple]) -> pa.Table:
    block, kind, other, data = zip(*rows) if rows else ((), (), (), ())
    return pa.table([pa.array(block, pa.int32()), pa.array(kind, pa.string()), pa.array(other, pa.int32()), pa.array(data, pa.binary())], names=["block", "kind", "other", "data"])


def _row(block: int, kind: str, other: int, *arrays: np.ndarray) -> tuple:
    return int(block), kind, int(other), pickle.dumps(arrays, 5)


def _read(table: pa.Table) -> dict[str, list[tuple]]:
    """By kind: (other, arrays), by other."""
    out: dict[str, list[tuple]] = {}
    for kind, other, data in sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "other", "data"))), key=lambda r: r[:2]):
        out.setdefault(kind, []).append((other, pickle.loads(data)))
    return out


def _cut(keys: np.ndarray, n: int):
    """(key, places) of a sort by keys below n, in order."""
    order = np.argsort(keys.astype(np.uint16) if n <= 1 << 16 else keys, kind="stable")  # of 16 bits by radix
    size = np.bincount(keys, minlength=n)
    ends = np.cumsum(size)
    for key in np.flatnonzero(size):
        yield key, order[(ends[key - 1] if key else 0) : ends[key]]


def _packer(blocks: int):
    """Batches of edges (src, dst, w) or nodes (id) to rows E or N of their blocks."""

    def packed(held):
        cols = [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]
        if len(cols) == 1:
            return _rows([_row(b, "N", 0, cols[0][at]) for b, at in _cut(_block(cols[0], blocks), blocks)])
        src, dst, w = cols
        s, t, ww, ahead = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w]), np.arange(2 * len(w)) < len(w)
        return _rows([_row(b, "E", 0, s[at], t[at], ww[at], ahead[at]) for b, at in _cut(_block(s, blocks), blocks)])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += len(batch)
            if n >= PACKED:
                yield from packed(held).to_batches()
                held, n = [], 0
        if n:
            yield from packed(held).to_batches()

    return run


def _partial(c: np.ndarray, d: np.ndarray, own: int, blocks: int) -> list[tuple]:
    """The block's share of its communities' weights."""
    u, at = np.unique(c, return_inverse=True)
    sums = np.bincount(at, d, len(u))
    return [_row(b, "P", own, u[i], sums[i]) for b, i in _cut(_block(u, blocks), blocks)]


def _builder(blocks: int):
    def build(key, table):
        own, got = key[0].as_py(), _read(table)
        ids = np.unique(np.concatenate([a[0] for _, a in got.get("N", [])])) if "N" in got else np.zeros(0, np.int64)
        if not len(ids):
            return _rows([])
        s, t, w, ahead = (np.concatenate([a[i] for _, a in got["E"]]) for i in range(4)) if "E" in got else (np.zeros(0, k) for k in ("i8", "i8", "f8", "?"))
        at = np.minimum(np.searchsorted(ids, s), len(ids) - 1)
        known = ids[at] == s
        at, t, w, ahead = at[known], t[known], w[known], ahead[known]
        ends, place = np.unique(t, return_inverse=True)
        place = place.reshape(-1)
        order = np.argsort((at * max(1, len(ends)) + place) * 2 + ahead)
        at, t, w, ahead, place = at[order], t[order], w[order], ahead[order], place[order]
        d, out = np.bincount(at, w, len(ids)), np.bincount(at, w * ahead, len(ids))
        values, code = np.unique(w, return_inverse=True)
        weights = (code.reshape(-1).astype(np.uint8), values) if len(values) <= 256 else (w, None)
        rank, rows = np.zeros(len(ends), np.int32), []
        n = 0
        for b, i in _cut(_block(ends, blocks), blocks):
            rank[i] = np.arange(n, n + len(i))
            n += len(i)
            rows.append(_row(b, "R", own, ends[i]))
        rows += [_row(own, "S", 1, ids, ids, d, out, d), _row(own, "A", 0, at.astype(np.int32), rank[place], *weights, np.flatnonzero(ids[at] == t))]
        return _rows(rows + _partial(ids, d, own, blocks))

    return build


def _resolved(key, table):
    """Places in this block of the nodes that others ask for, -1 where there is none."""
    own, got = key[0].as_py(), _read(table)
    ids = got["S"][0][1][0] if "S" in got else np.zeros(0, np.int64)
    rows = []
    for other, (asked,) in got.get("R", []):
        at = np.searchsorted(ids, asked)
        found = ids[np.minimum(at, len(ids) - 1)] == asked if len(ids) else np.zeros(len(asked), bool)
        rows.append(_row(own, "R", other, np.where(found, at, -1).astype(np.int32)))
    return _rows(rows)


def _owner(key, table):
    """Sums what the blocks have of a community's weight and answers each."""
    own, parts = key[0].as_py(), _read(table)["P"]
    c = np.concatenate([a[0] for _, a in parts])
    u, at = np.unique(c, return_inverse=True)
    total = np.bincount(at, np.concatenate([a[1] for _, a in parts]), len(u))[at]
    ends = np.cumsum([len(a[0]) for _, a in parts])
    return _rows([_row(other, "V", own, c[e - len(a[0]) : e], total[e - len(a[0]) : e]) for (other, a), e in zip(parts, ends)])


def _sender(last: bool):
    """State to the blocks that ask for it: community and its weight, or after the last sweep the weight of edges out."""

    def send(key, table):
        own, got = key[0].as_py(), _read(table)
        asked = got.get("R", [])
        if "S" not in got:
            return _rows([_row(other, "M", own, np.full(len(at), NONE), np.zeros(len(at))) for other, (at,) in asked])
        ids, c, d, out, weight = got["S"][0][1]
        if not last:
            known, sums = (np.concatenate([a[i] for _, a in got["V"]]) for i in range(2))
            order = np.argsort(known)
            weight = sums[order][np.searchsorted(known[order], c)]
        tell, rows = out if last else weight, [_row(own, "S", 0, ids, c, d, out, weight)]
        for other, (at,) in asked:
            rows.append(_row(other, "M", own, np.where(at < 0, NONE, c[at]), tell[at]))
        return _rows(rows)

    return send


def _coded(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as places among the distinct ones, in no order."""
    d = pa.array(c).dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.to_numpy()


def _met(got):
    """(node, community of the other end, what was sent of it, weight, whether a loop) of the edges between nodes, and the communities."""
    at, place, w, values, loops = got["A"][0][1]
    w = w if values is None else values[w]
    if not len(at):
        return at, place, np.zeros(0), w, np.zeros(0, bool), np.zeros(0, np.int64)
    c, told = (np.concatenate([a[i] for _, a in got["M"]]) for i in range(2))
    loop = np.zeros(len(at), bool)
    loop[loops] = True
    of, names = _coded(c)
    known = c[place] != NONE
    if not known.all():
        at, place, w, loop = at[known], place[known], w[known], loop[known]
    return at, of[place], told[place], w, loop, names


def _mover(m: float, gamma: float, salt: int, blocks: int):
    """One sweep: the half of the nodes that ``salt`` picks moves; where none of a block's would, the other half's wishes are looked at as well."""

    def wishes(at, comm, weight, w, names, c, d, n):
        """(node, community, whether it isn't the node's own) of the best gain above 0."""
        key = at.astype(np.int64) * len(names) + comm
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        k, one = np.add.reduceat(w[order], new), order[new]
        node, to = at[one], names[comm[one]]
        mine = to == c[node]
        g = k / m - gamma * d[node] * (weight[one] - np.where(mine, d[node], 0.0)) / (2 * m * m)
        g = np.copysign(np.floor(np.abs(g) * 1e12 + 0.5), g)  # to 12 digits
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.append(first, len(node)))
        top = np.maximum.reduceat(g, first)
        best = g == np.repeat(top, size)
        stay = np.logical_or.reduceat(best & mine, first)
        least = np.minimum.reduceat(np.where(best, to, np.iinfo(np.int64).max), first)
        go = (top > 0) & ~stay
        return node[first][go], least[go]

    def move(key, table):
        own, got = key[0].as_py(), _read(table)
        if "S" not in got:
            return _rows([])
        ids, c, d, out, weight = got["S"][0][1]
        at, comm, told, w, _, names = _met(got)
        turn, wish, new = xxhash64(ids, salt) & np.uint64(1) == 0, False, c
        for half in (True, False):
            pick = turn[at] == half
            if wish or not pick.any():
                continue
            node, to = wishes(at[pick], comm[pick], told[pick], w[pick], names, c, d, len(ids))
            wish = len(node) > 0
            if half:
                new = c.copy()
                new[node] = to
        return _rows([_row(own, "S", wish, ids, new, d, out, weight), *_partial(new, d, own, blocks)])

    return move


def _summer(m: float, gamma: float):
    """Of a block's communities: inner and outer weight, and modularity's terms of inner edges and of loops (of an edge twice, as of both its ends)."""

    def run(key, table):
        got = _read(table)
        if "S" not in got:
            return _sums(np.zeros(0, np.int64), *[np.zeros(0)] * 4)
        _, c, _, out, _ = got["S"][0][1]
        at, comm, told, w, loop, names = _met(got)
        own, of = np.unique(c, return_inverse=True)
        same = names[comm] == c[at]
        term = w - gamma * out[at] * told / (2 * m)
        add = lambda x: np.bincount(of[at], x, len(own))
        return _sums(own, add(w * same), add(w * ~same), add(term * same), add(term * loop))

    return run


def _sums(*cols: np.ndarray) -> pa.Table:
    return pa.table([pa.array(x) for x in cols], names=["c", "i", "o", "inner", "loops"])


def _nodes(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            ids, c = pickle.loads(data)[:2]
            for lo in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + (1 << 16)]), pa.array(c[lo : lo + (1 << 16)])], names=["id", "c"])


def _kept(df: DataFrame):
    """Writes rows by kind; a function that reads those of the kinds asked for."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/leiden-{uuid.uuid4().hex}"
    df.write.partitionBy("kind").parquet(path)
    table = spark.read.schema("block int, other int, data binary, kind string").parquet(path).select("block", "kind", "other", "data")
    return lambda *kinds: table.where(F.col("kind").isin(*kinds))


def moved(nodes: DataFrame, edges: DataFrame, m: float, sweeps: int, gamma: float, seed: int) -> tuple[DataFrame, DataFrame] | None:
    """After the sweeps over edges (src, dst, w): nodes (id, c), and of communities that have edges (c, i, o, inner, loops), see _summer.

    None if hot nodes would make a block too large for a task.
    """
    blocks = -(-2 * edges.count() // ENDS)
    ends = edges.select(*(F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias(c) for c in ("src", "dst")), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    if ends.select("src").unionByName(ends.select(F.col("dst").alias("src"))).groupBy(F.pmod(F.xxhash64("src"), F.lit(blocks))).count().agg(F.max("count")).first()[0] > SKEW * ENDS:
        return None
    # blobs are shuffled and not stored, as a reader would hold a file's many at once
    packed = ends.mapInArrow(_packer(blocks), ROW).unionByName(nodes.where("id IS NOT NULL").select(F.col("id").cast("long")).mapInArrow(_packer(blocks), ROW))
    each = lambda df, f, schema=ROW: df.groupBy("block").applyInArrow(f, schema)
    made = _kept(each(packed, _builder(blocks)))
    asked = _kept(each(made("S", "R"), _resolved))("R")
    state = made
    for sweep in range(sweeps):
        told = each(each(state("P"), _owner).unionByName(state("S")).unionByName(asked), _sender(False))
        state = _kept(each(told.unionByName(made("A")), _mover(m, gamma, seed + sweep, blocks)))
        if state("S").where("other = 1").isEmpty():
            break
    told = each(state("S").unionByName(asked), _sender(True))
    sums = each(told.unionByName(made("A")), _summer(m, gamma), "c long, i double, o double, inner double, loops double")
    total = stored(sums.groupBy("c").agg(*(F.sum(x).alias(x) for x in ("i", "o", "inner", "loops"))), "leiden")
    return state("S").select("data").mapInArrow(_nodes, "id long, c long"), total
