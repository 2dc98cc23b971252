"""Embedding near-dedup by spherical-cap filters from structured random product codes.

Vectors are linked if their cosine, in double precision, is at least ``least``.

*Filters.* A code rotates the vectors at random, cuts them into two blocks and has
``K`` random unit directions for either; each of the K * K pairs is a filter direction, and
its score is the sum of two block scores. A vector is list-decoded to every filter whose
score reaches the code's cap height, which is set so that a vector exceeds ``CAPS`` filters of a code on
average. Only directions that reach it together with the other block's best can take part, so decoding looks at few of the K * K.
A product code's lists are uneven, and a vector in no list would be lost: where fewer than ``FEWEST`` filters
reach the height, it is lowered to the vector's own ``FEWEST``-th best. ``CODES`` independent codes are used. K grows with the square root of the number
of distinct vectors, so a filter holds about ``PER_FILTER`` vectors whatever their number.

*Join.* Vectors meet in their common filters twice. First their 4-bit codes do, an eighth of the size; an error bound that
goes with each code makes sure that no link is missed, and only (filter, vector) with some possible partner go on. These
meet with their exact vectors and are compared. A pair counts in
the least filter that it shares, so counts are summed without emitting a pair, and a
task puts out a spanning forest of a cell's links. A filter with more than ``HOT`` vectors
is split into groups; each pair of groups is a cell of its own, so a task holds at most
two groups.

Equal vectors are one class (partial aggregate on a digest); only its least vec_id goes on.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with
null vec_id, link with nothing (0 links, their own component, kept); vectors of different
lengths don't link; repeated rows are vectors of their own, and rows that share a vec_id are one node; an empty table gives no rows;
other columns are ignored. Recall is probabilistic: measured in the tests against brute force.

Cost that stays: a vector that is really linked with N others takes N comparisons, as its links are counted exactly, so N vectors
that are all linked take N * N / 2, in cells of HOT * HOT.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .runtime import components, hot_join, plain, table

LEAST = 0.95
CODES = 4
CAPS = 1.0
FEWEST = 3
PER_FILTER = 512
HOT = 8192
HOT_MAP = 50_000
LENGTH_BITS = 42
LEVELS = 7
_FILTER = (1 << LENGTH_BITS) - 1
_codes: dict = {}


def directions(n: int) -> int:
    """K for n distinct vectors."""
    return int(max(8, np.ceil(np.sqrt(n * max(CAPS, FEWEST) / PER_FILTER))))


def code(d: int, k: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions of both blocks, turned back by the rotation: (d, k) each, so that scores are x @ a and x @ b."""
    if (d, k, c) not in _codes:
        rng = np.random.RandomState(1000 * c + 17)
        q = np.linalg.qr(rng.standard_normal((max(d, 2), max(d, 2))))[0][:d]
        half = max(d, 2) // 2
        out = []
        for lo, hi in ((0, half), (half, max(d, 2))):
            v = rng.standard_normal((hi - lo, k))
            out.append(q[:, lo:hi] @ (v / np.linalg.norm(v, axis=0)))
        _codes[d, k, c] = tuple(out)
    return _codes[d, k, c]


def height(d: int, k: int, c: int) -> float:
    """The score that CAPS of the K * K filters reach on average, over random unit vectors."""
    if ("height", d, k, c) not in _codes:
        x = np.random.RandomState(5).standard_normal((128, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = code(d, k, c)
        s, t = x @ a, np.sort(x @ b, axis=1)
        lo, hi = -2.0, 2.0
        for _ in range(25):
            h = (lo + hi) / 2
            n = sum(int((k - np.searchsorted(t[r], h - s[r])).sum()) for r in range(len(x)))
            lo, hi = (h, hi) if n > CAPS * len(x) else (lo, h)
        _codes["height", d, k, c] = hi
    return _codes["height", d, k, c]


def decode(x: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted filters of each unit vector."""
    n, rows, found = len(x), [], []
    for c in range(CODES):
        a, b = code(x.shape[1], k, c)
        s, t = x @ a, x @ b
        m = min(k, FEWEST)
        i, j = (np.argpartition(-z, m - 1, axis=1)[:, :m] for z in (s, t))
        both = (np.take_along_axis(s, i, 1)[:, :, None] + np.take_along_axis(t, j, 1)[:, None, :]).reshape(n, -1)
        h = np.minimum(height(x.shape[1], k, c), np.sort(both, axis=1)[:, -m])[:, None] - 1e-9
        # directions of either block that reach it with the other's best, then all of their pairs
        r, i = np.nonzero(s >= h - t.max(1, keepdims=True))
        q, j = np.nonzero(t >= h - s.max(1, keepdims=True))
        many = np.bincount(q, minlength=n)
        first = np.concatenate([[0], np.cumsum(many)])
        each = many[r]
        at = np.repeat(np.arange(len(r)), each)
        row, i = r[at], i[at]
        j = j[first[row] + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)]
        ok = s[row, i] + t[row, j] >= h[row, 0]
        rows.append(row[ok])
        found.append(c * k * k + i[ok] * k + j[ok])
    row, f = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((f, row))
    return np.split(f[order], np.cumsum(np.bincount(row, minlength=n))[:-1])


def _sketch(x: np.ndarray) -> list[bytes]:
    """Unit vectors in 4 bits a component: scale, bound of the error's norm, codes."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    q = np.rint(x / scale * LEVELS)
    error = np.linalg.norm(x - q * scale / LEVELS, axis=1) * 1.0001 + 1e-6
    q = (q + LEVELS).astype(np.uint8)
    if q.shape[1] % 2:
        q = np.column_stack([q, np.zeros(len(q), np.uint8)])
    q = q[:, ::2] << 4 | q[:, 1::2]
    return [a.tobytes() + b.tobytes() for a, b in zip(np.column_stack([scale, error]).astype("<f4"), q)]


def _unsketch(raw: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Approximate vectors and their errors' bounds from rows of bytes."""
    about = raw[:, :8].copy().view("<f4")
    q = np.empty((len(raw), 2 * (raw.shape[1] - 8)), np.float32)
    q[:, ::2], q[:, 1::2] = raw[:, 8:] >> 4, raw[:, 8:] & 15
    return (q[:, :d] - LEVELS) * (about[:, :1] / LEVELS), about[:, 1] + np.float32(1e-5)


def _read(vec: str):
    def run(batches):
        for batch in batches:
            out, digest = [], []
            for v in batch.column(1):
                x = None
                if v.is_valid and len(v.values):
                    v = v.values
                    if not v.null_count:
                        x = v.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                        with np.errstate(over="ignore"):
                            if not np.isfinite(x).all() or not x.any():
                                x = None
                out.append(None if x is None else _encode(x))
                digest.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(out, pa.binary())], names=["vec_id", "digest", "vec"])

    return run


def _encode(x: np.ndarray) -> bytes:
    """A type's letter and the values, in single precision where that is exact."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return b"f" + short.tobytes() if (short == x).all() else b"d" + x.astype("<f8").tobytes()


def _length(raw: bytes) -> int:
    return (len(raw) - 1) // (4 if raw[:1] == b"f" else 8)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f4" if r[:1] == b"f" else "<f8", offset=1) for r in raw]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(vec: pa.Array, k: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Each vector's filters, with its length above them, and its sketch."""
    raw = vec.to_pylist()
    size = np.array([_length(r) for r in raw])
    out, short = [None] * len(raw), [b""] * len(raw)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        for lo in range(0, len(at), 1024):
            part = at[lo : lo + 1024]
            x = _unit([raw[i] for i in part])
            for i, f, q in zip(part.tolist(), decode(x, k), _sketch(x)):
                out[i], short[i] = f + (d << LENGTH_BITS), q
    return out, short


def _filters(k: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_lists(batch.column(0), k)[0]))], names=["f"])

    return run


_HEAD = np.dtype([("rep", "<i8"), ("g", "<i4")])


def _blobs(f: list, s: list, n: list):
    """Rows (f, ab, s) of all cells of filters f that are split into n groups; s begins with a vector's id, and its group is put in."""
    out: tuple[list, list, list] = ([], [], [])
    for x, blob, many in zip(f, s, n):
        rep = np.frombuffer(blob, "<i8", 1)
        r = int(tv.mix(rep.astype(np.uint64))[0] % np.uint64(many)) if many > 1 else 0
        blob = np.array((rep[0], r), _HEAD).tobytes() + blob[_HEAD.itemsize :] if r else blob
        for z in range(many):
            out[0].append(x)
            out[1].append(min(r, z) << 32 | max(r, z))
            out[2].append(blob)
    for lo in range(0, len(out[0]), 16384):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 16384], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()))], names=["f", "ab", "s"])


def _cells(k: int, groups: dict[int, int]):
    """(rep, vec) to (f, ab, s): a row for each cell of each filter; ab are the cell's two groups, s is the id, its group and the sketch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists, short = _lists(batch.column(1), k)
                heads = [np.array((r, 0), _HEAD).tobytes() + q for r, q in zip(batch.column(0).to_pylist(), short)]
                f = np.concatenate(lists).tolist()
                yield from _blobs(f, [h for h, mine in zip(heads, lists) for _ in mine], [groups.get(x, 1) for x in f])

    return run


def _split(batches):
    for batch in batches:
        yield from _blobs(*(c.to_pylist() for c in batch.columns))


def _in_cells(batches, done):
    """Gathers rows (f, ab, ..) that are in order of their cells, and calls done(cell, rows) for each."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        f, ab = (batch.column(i).to_numpy() for i in range(2))
        cut = [0, *(np.flatnonzero((f[1:] != f[:-1]) | (ab[1:] != ab[:-1])) + 1).tolist(), len(f)]
        for a, b in zip(cut, cut[1:]):
            if (f[a], ab[a]) != key:
                if key and (out := done(key, held)) is not None:
                    yield out
                key, held = (f[a], ab[a]), []
            held.append(batch.slice(a, b - a))
    if key and (out := done(key, held)) is not None:
        yield out


def _possible(least: float):
    def done(key, parts):
        """(f, ab, rep, g) of the cell's vectors that some other may be linked with."""
        raw = np.frombuffer(b"".join(x for p in parts for x in p.column(2).to_pylist()), np.uint8)
        n = sum(p.num_rows for p in parts)
        if n < 2:
            return None
        raw = raw.reshape(n, -1)
        head = raw[:, : _HEAD.itemsize].copy().view(_HEAD)[:, 0]
        x, e = _unsketch(raw[:, _HEAD.itemsize :], int(key[0]) >> LENGTH_BITS)
        some, apart = np.zeros(n, bool), key[1] >> 32 != key[1] & 0xFFFFFFFF
        for lo in range(0, n, 512):
            at = slice(lo, lo + 512)
            may = x[at] @ x.T >= least - (e[at, None] + e[None] + e[at, None] * e[None])
            may[np.arange(len(may)), lo + np.arange(len(may))] = False
            if apart:
                may &= head["g"][at, None] != head["g"][None]
            some[at] |= may.any(1)
        at = np.flatnonzero(some)
        if not len(at):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key[0])), pa.array(np.full(len(at), key[1])), pa.array(head["rep"][at]), pa.array(head["g"][at])], names=["f", "ab", "rep", "g"])

    return lambda batches: _in_cells(batches, done)


def _with_lists(k: int):
    def run(batches):
        """(rep, members, vec) with the filters of each, without its length."""
        for batch in batches:
            if batch.num_rows:
                lists = [(m & _FILTER).astype("<i8").tobytes() for m in _lists(batch.column(2), k)[0]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.binary())], names=["rep", "members", "vec", "lists"])

    return run


def _padded(lists: list[bytes]) -> np.ndarray:
    """A row for each list, filled up with numbers that no other row has."""
    rows = [np.frombuffer(x, "<i8") for x in lists]
    out = np.repeat(-1 - np.arange(len(rows))[:, None], max(map(len, rows)), axis=1)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _first_common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least number that two rows share, their own ones in order."""
    out = np.where(p[:, 0] == q[:, 0], p[:, 0], -1)
    rest = np.flatnonzero(out < 0)
    for lo in range(0, len(rest), 4096):
        r = rest[lo : lo + 4096]
        same = (p[r][:, :, None] == q[r][:, None, :]).any(2)
        out[r] = np.where(same.any(1), p[r, same.argmax(1)], -1)
    return out


def _compare(least: float):
    def done(key, parts):
        """(rep, n, to): n linked vectors counted here, or an edge of the cell's spanning forest. Rows are (f, ab, g, rep, members, vec, lists)."""
        n = sum(p.num_rows for p in parts)
        if n < 2:
            return None
        col = lambda i: [x for p in parts for x in p.column(i).to_pylist()]
        g, rep, members = (np.array(col(i)) for i in (2, 3, 4))
        x, lists = _unit(col(5)), _padded(col(6))
        f, apart = int(key[0]) & _FILTER, key[1] >> 32 != key[1] & 0xFFFFFFFF
        count, us, vs = np.zeros(n, np.int64), [], []
        for lo in range(0, n, 256):
            s = x[lo : lo + 256] @ x.T
            ok = (s >= least) & (np.arange(lo, min(lo + 256, n))[:, None] < np.arange(n)[None])
            if apart:
                ok &= g[lo : lo + 256][:, None] != g[None]
            i, j = np.nonzero(ok)
            i += lo
            if len(i):
                mine = _first_common(lists[i], lists[j]) == f
                i, j = i[mine], j[mine]
                np.add.at(count, i, members[j])
                np.add.at(count, j, members[i])
                us.append(i)
                vs.append(j)
        if not us:
            return None
        i, j = np.concatenate(us), np.concatenate(vs)
        label = np.arange(n)
        while True:  # least label over links, with shortcuts
            low = np.minimum(label[i], label[j])
            new = label.copy()
            for at in (label[i], label[j], i, j):
                np.minimum.at(new, at, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        at, tree = np.flatnonzero(count), np.flatnonzero(label != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(np.r_[rep[at], rep[tree]]), pa.array(np.r_[count[at], np.zeros(len(tree), np.int64)]), pa.array(np.r_[np.full(len(at), -1), rep[label[tree]]], mask=np.r_[np.ones(len(at), bool), np.zeros(len(tree), bool)])], names=["rep", "n", "to"])

    return lambda batches: _in_cells(batches, done)


def groups(vectors: DataFrame, least: float = LEAST, vec: str = "embedding", hot: int = HOT, hot_map: int = HOT_MAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    vectors, _ = plain(vectors, ["vec_id", vec], keep=[])
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec).mapInArrow(_read(vec), "vec_id long, digest binary, vec binary")
    rows = table(read.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")), "vectors")
    classes = read.where(F.col("digest").isNotNull() & F.col("vec_id").isNotNull()).groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("members"), F.first("vec").alias("vec"))
    classes = table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    k = directions(classes.count())
    src = classes.select("rep", "vec")
    crowded = table(classes.select("vec").mapInArrow(_filters(k), "f long").groupBy("f").count().where(F.col("count") > hot).select("f", F.ceil(F.col("count") / (hot // 2)).cast("int").alias("n")), "crowded")
    if crowded.count() <= hot_map:
        cells = src.mapInArrow(_cells(k, {r[0]: r[1] for r in crowded.collect()}), "f long, ab long, s binary")
    else:  # too many to send to every task: the cells of crowded filters come from a join
        one = src.mapInArrow(_cells(k, {}), "f long, ab long, s binary")
        cells = one.join(crowded, "f", "left").select("f", "s", F.coalesce("n", F.lit(1)).alias("n")).mapInArrow(_split, "f long, ab long, s binary")
    near = table(cells.repartition("f", "ab").sortWithinPartitions("f", "ab").mapInArrow(_possible(least), "f long, ab long, rep long, g int"), "possible")
    exact = table(classes.join(near.select("rep").distinct(), "rep", "left_semi").select("rep", "members", "vec").mapInArrow(_with_lists(k), "rep long, members long, vec binary, lists binary"), "exact")
    found = near.join(exact, "rep").select("f", "ab", "g", "rep", "members", "vec", "lists")
    found = table(found.repartition("f", "ab").sortWithinPartitions("f", "ab").mapInArrow(_compare(least), "rep long, n long, to long"), "found")
    n = found.where(F.col("to").isNull()).groupBy("rep").agg(F.sum("n").alias("n"))
    of = classes.select("digest", "rep", "least", "members")
    comp = table(components(found.where(F.col("to").isNotNull()).select("rep", "to").union(_one_node(rows, of)), "rep", "to").withColumnRenamed("id", "rep").join(of.select("rep", "least"), "rep"), "linked")
    low = table(comp.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "least")
    comp = hot_join(comp, low, "component", "size", comp.count()).select("rep", "component_id")
    of = table(of.join(n, "rep", "left").join(comp, "rep", "left").select("digest", "members", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component_id", "least").alias("component")), "of")
    out = hot_join(rows, of, "digest", "members", rows.count(), "left")
    node = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n") + F.col("members") - 1, F.lit(0)).cast("long").alias("n_links"), node.alias("component_id"), F.coalesce(F.col("vec_id") == node, F.lit(True)).alias("kept"))


def _one_node(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (rep, to) between the classes of each vec_id that has several."""
    some = rows.where(F.col("digest").isNotNull())
    many = some.groupBy("vec_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi").select("vec_id")
    own = table(some.join(many, "vec_id", "left_semi").distinct().join(classes.select("digest", "rep"), "digest").select("vec_id", "rep"), "shared")
    hub = table(own.groupBy("vec_id").agg(F.min("rep").alias("hub"), F.count("*").alias("n")), "hubs")
    return hot_join(own, hub, "vec_id", "n", own.count()).where("rep <> hub").select("rep", F.col("hub").alias("to"))
