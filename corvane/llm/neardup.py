"""MinHash near-dedup with tensored banding; every link is confirmed on full shingle sets.

A document's set holds its distinct 3-word shingles (A-Z lower-cased words between ASCII
white space; with fewer words the whole sequence is one shingle) as 64-bit hashes.
Documents are linked if 100 * |intersection| >= ``percent`` * |union|.

*Tensored banding.* Two collections of ``BANDS`` half-bands, each of ``ROWS`` minhashes, are
computed (2 * 8 * 2 = 32 minhashes), and every pair of a half-band of the first with one of
the second is the key of a table: 64 tables of 4 rows for 32 minhashes, not 256. Two sets
miss all tables only if they agree in no half-band of one collection: at a similarity
of 0.85 with probability 2 * (1 - 0.85**2)**8 = 7e-5, less above.

*Classes.* Documents with the same set are one class, found by a partial aggregate on
the set's digest, with a number of its own; its least doc_id stands for its text. Copies never pair up.
Where rows share a doc_id but not a set, an edge for each further class of this doc_id joins them up.

*Candidates.* A table's bucket is streamed in order of set size; each member is tied to the
bucket's first member (or to a later one where the sizes alone rule out a link), a star
and so linear in the bucket. Buckets with more than a ``HOT_SHARE``-th of all rows (and ``HOT_BUCKET``) are found by
Misra-Gries counts beforehand, each task's merged by one aggregate, and are split by salt; every salt has stars of its own. Pairs whose 32 minhashes agree in fewer than
``AGREE`` bytes are screened out (a link of 0.85 fails with probability below 1e-5). Of the
rest each member's best is verified: round one. After it, only buckets that hold different
components matter; their members whose sketches allow a link across components form families (again
by a forest of each bucket, not by pairs; a bucket of more than ``CELL_ROWS`` is cut into groups, and each pair of groups is a task's cell of its own), and round two compares the members of a family
that are in different components, so no pair of a bucket stays undecided.

*Verification.* Round one sends each member's set once to its centre's task (a centre with
many members is spread over salts), where the centre's set alone is held. Round two sends each
set once to its family's task; a family of more than ``BLOCK_BYTES`` of sets is split into
groups, and each pair of groups is a cell of its own, so a task holds at most two groups.

Defined results: documents without words or with null text have an empty set and link with
nothing, as do rows with null doc_id (component null, kept); rows that share a doc_id are one node;
an empty table gives no rows; other columns of docs are kept by near_dedup(), whatever their names.

Cost that stays: of N documents that share a bucket and are all similar to each other, but not linked, every two are
compared by their 32-byte sketches, N * N / 2 in cells of CELL_ROWS * CELL_ROWS.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .runtime import components, hot_join, plain, table

BANDS = 8
ROWS = 2
HASHES = 2 * BANDS * ROWS
AGREE = 17
PERCENT = 85
SALT_PAIRS = 2048
BLOCK_BYTES = 16 << 20
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 256  # of a broadcast row, at most
HOT_SHARE = 1 << 15
HOT_BUCKET = 1 << 18
HEAVY = 1 << 17
CELL_ROWS = 1 << 13
_rng = np.random.RandomState(85)
_XOR = _rng.randint(0, 1 << 62, HASHES).astype(np.uint64)
_MUL = _rng.randint(0, 1 << 62, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    s, e, wp = tv.words(buf, off, tv.SOLID)
    h = tv.hashes(buf, s, e)
    three = tv.mix(tv.mix(tv.mix(h[:-2]) + h[1:-1]) + h[2:]) if len(h) > 2 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(wp[:-1].tolist(), wp[1:].tolist()):
        if b - a >= 3:
            x = np.sort(three[a : b - 2])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b - a == 2:
            out.append(tv.mix(tv.mix(h[a : a + 1]) + h[a + 1 : b] + np.uint64(2)))
        else:
            out.append(tv.mix(h[a:b] + np.uint64(1)))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """The minhashes of sets that aren't empty, a row for each."""
    x = np.concatenate(sets)
    ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        y = x ^ _XOR[k]
        y *= _MUL[k]
        out[:, k] = np.minimum.reduceat(y, ptr)
    return out


def _digest(items: bytes) -> bytes:
    return hashlib.blake2b(items, digest_size=16).digest()


def _signed(batches):
    for batch in batches:
        n, digest, bands, sketch = [], [], [], []
        for _, _, buf, off in tv.chunks(batch.column(1)):
            sets = shingle_sets(buf, off)
            full = [s for s in sets if len(s)]
            if full:
                m = tv.mix(minhashes(full))
                half = tv.mix(tv.mix(m[:, 0::2]) + m[:, 1::2]) >> np.uint64(32)
                some = iter(zip(half.astype("<u4"), (m >> np.uint64(56)).astype(np.uint8)))
            for s in sets:
                n.append(len(s))
                if len(s):
                    a, b = next(some)
                    digest.append(_digest(s.tobytes()))
                    bands.append(a.tobytes())
                    sketch.append(b.tobytes())
                else:
                    for c in (digest, bands, sketch):
                        c.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (digest, bands, sketch))], names=["doc_id", "n", "digest", "bands", "sketch"])


def _table_keys(bands: pa.Array) -> np.ndarray:
    """The keys of all tables for each class, a row for each."""
    n = len(bands)
    half = np.frombuffer(b"".join(bands.to_pylist()), "<u4").reshape(n, 2 * BANDS).astype(np.uint64)
    step = np.arange(BANDS * BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return tv.mix(((half[:, :BANDS, None] << np.uint64(32)) | half[:, None, BANDS:]).reshape(n, -1) + step).view(np.int64)


def _heavy(batches):
    """(key, n): a lower bound of a key's count in this task, short of it by at most a HEAVY-th of the task's rows, where it is not below that."""
    keys, counts, held, total = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged():
        k, at = np.unique(np.concatenate([keys, *held]), return_inverse=True)
        c = np.bincount(at, np.concatenate([counts, np.ones(len(at) - len(counts))])).astype(np.int64)
        if len(k) > HEAVY:
            c = c - np.partition(c, len(c) - HEAVY - 1)[len(c) - HEAVY - 1]
        return k[c > 0], c[c > 0]

    for batch in batches:
        for lo in range(0, batch.num_rows, 8192):
            held.append(_table_keys(batch.column(0).slice(lo, 8192)).ravel())
            total += len(held[-1])
            if sum(map(len, held)) >= HEAVY * 8:
                keys, counts = merged()
                held = []
    if held:
        keys, counts = merged()
    some = counts >= max(1, total // HEAVY)
    yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(counts[some])], names=["key", "n"])


def hot_buckets(classes: DataFrame, n_classes: int, hot_bucket: int = HOT_BUCKET, share: int = HOT_SHARE) -> dict[int, int]:
    """Salts of every key that more than a ``share``-th of all rows have, and more than ``hot_bucket``. What comes back is bounded by 2 * HOT_SHARE keys."""
    total = n_classes * BANDS * BANDS
    least = max(hot_bucket, total // share)
    if least >= n_classes:  # no bucket holds a class twice
        return {}
    short = 2 * (total // HEAVY)
    found = classes.select("bands").mapInArrow(_heavy, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > max(1, least - short)).collect()
    return {r[0]: 2 + (r[1] + short) // max(1, hot_bucket) for r in found}


def _keys(hot: dict[int, int]):
    def run(batches):
        """(key, salt, v, n) of each class in all tables; salt is -1 but for hot keys."""
        names = np.array(sorted(hot), np.int64)
        salts = np.array([hot[k] for k in names.tolist()], np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                key = _table_keys(part.column(2))
                v, n = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), key.shape[1]) for c in (0, 1))
                key = key.ravel()
                salt = np.full(len(key), -1, np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                    is_hot = names[at] == key
                    salt[is_hot] = (tv.mix(v[is_hot].astype(np.uint64)) % salts[at[is_hot]].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(v), pa.array(n)], names=["key", "salt", "v", "n"])

    return run


def _stars(percent: int):
    def run(batches):
        """From (key, salt, v, n) in order of key, salt, n, v: (key, v, n, u) of buckets of two or more and of all hot ones, u the star's centre."""
        state = None  # the last bucket's key and salt, its current centre with size, and whether it is out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, v, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            if state:
                key, salt, v, n = (np.r_[x, y] for x, y in zip(state, (key, salt, v, n)))
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            length = np.diff(np.r_[start, len(key)])
            centre = np.repeat(start, length)
            far = np.flatnonzero(100 * n[centre] < percent * n)
            for i in dict.fromkeys(centre[far].tolist()):
                j = i + int(length[np.searchsorted(start, i)])
                c = i
                while c < j:  # sizes ascend, so a star's members are a run
                    end = c + int(np.searchsorted(n[c:j], 100 * n[c] // percent, "right"))
                    centre[c : max(end, c + 1)] = c
                    c = max(end, c + 1)
            out = np.repeat(length > 1, length) | (salt >= 0)
            if state and state[4]:
                out[0] = False
            last = int(centre[-1])
            state = (key[-1], salt[-1], v[last], n[last], bool(length[-1] > 1 or salt[-1] >= 0) or bool(state and state[4] and start[-1] == 0))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(v[out]), pa.array(n[out]), pa.array(v[centre][out])], names=["key", "v", "n", "u"])

    return run


def _agree(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, HASHES) for c in (a, b))
    return (x == y).sum(1)


def _screen(batches):
    for batch in batches:
        k = _agree(batch.column(2), batch.column(3)) if batch.num_rows else np.zeros(0, np.int64)
        ok = pa.array(k >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(k[k >= AGREE])], names=["u", "v", "k"])


def _forest(percent: int):
    def run(batches):
        """From (key, a, b, g, n, v, c, sketch) in order of key, a, b, n, v: edges that join all members of a cell of a bucket between which some pair in different components c (and, where a and b differ, groups g) has sizes and sketches that allow a link. At most one edge a member and tree it joins; members too small for the current one leave memory."""
        key, held, tree = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ks, aa, bb, g, n, v, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            sk = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, HASHES)
            start = np.flatnonzero(np.r_[True, (ks[1:] != ks[:-1]) | (aa[1:] != aa[:-1]) | (bb[1:] != bb[:-1])])
            us, vs = [], []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(ks)]):
                for i in range(a, b, 256):
                    j = min(b, i + 256)
                    now = (n[i:j], v[i:j], c[i:j], sk[i:j], g[i:j])
                    if (ks[a], aa[a], bb[a]) != key:
                        key, held, tree = (ks[a], aa[a], bb[a]), tuple(x[:0] for x in now), np.zeros(0, np.int64)
                    keep = 100 * held[0] >= percent * n[i]
                    held = tuple(np.concatenate([x[keep], y]) for x, y in zip(held, now))
                    tree = np.concatenate([tree[keep], now[1]])
                    base = len(held[0]) - (j - i)
                    may = np.zeros((j - i, len(held[0])), bool)
                    for at in range(0, len(held[0]), 4096):
                        h = tuple(x[at : at + 4096] for x in held)
                        ok = (now[2][:, None] != h[2][None]) & (100 * h[0][None] >= percent * now[0][:, None]) & (np.arange(at, at + len(h[0]))[None] < base + np.arange(j - i)[:, None])
                        if key[1] != key[2]:
                            ok &= now[4][:, None] != h[4][None]
                        q, p = np.nonzero(ok)
                        may[q, at + p] = (now[3][q] == h[3][p]).sum(1) >= AGREE
                    for q in np.flatnonzero(may.any(1)).tolist():
                        own = tree[base + q]
                        for root in np.unique(tree[may[q]]).tolist():
                            if root != own:
                                us.append(held[1][base + q])
                                vs.append(root)
                                tree[tree == root] = own
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(us, np.int64)), pa.array(np.array(vs, np.int64))], names=["u", "v"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _cells(percent: int):
    def run(batches):
        """From (family, a, b, g, m, c, sketch, items) in order of the first three: links (u, v) that join components, of pairs in different components."""
        key, held = None, []

        def done():
            if len(held) < 2:
                return None
            held.sort(key=lambda h: (len(h[4]), h[1]))
            sets = [np.frombuffer(h[4], np.uint64) for h in held]
            n = np.array([len(x) for x in sets])
            g, m = (np.array([h[i] for h in held]) for i in (0, 1))
            label = np.unique([h[2] for h in held], return_inverse=True)[1]
            sk = np.frombuffer(b"".join(h[3] for h in held), np.uint8).reshape(-1, HASHES)
            us, vs = [], []
            for i in range(1, len(held)):
                lo = int(np.searchsorted(n, -(-percent * n[i] // 100)))
                ok = label[lo:i] != label[i]
                if key[1] != key[2]:
                    ok &= g[lo:i] != g[i]
                j = lo + np.flatnonzero(ok)
                j = j[(sk[j] == sk[i]).sum(1) >= AGREE]
                for k in j.tolist():
                    if label[k] != label[i]:
                        both = _overlap(sets[k], sets[i])
                        if 100 * both >= percent * (n[i] + n[k] - both):
                            us.append(m[k])
                            vs.append(m[i])
                            label[label == label[k]] = label[i]
            return pa.RecordBatch.from_arrays([pa.array(np.array(us, np.int64)), pa.array(np.array(vs, np.int64))], names=["u", "v"]) if us else None

        for batch in batches:
            for f, a, b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (f, a, b) != key:
                    if (out := done()) is not None:
                        yield out
                    key, held = (f, a, b), []
                held.append(row)
        if (out := done()) is not None:
            yield out

    return run


def _sets(batches):
    """(rep, digest, items) of documents that have a set; of repeated rows one a task."""
    seen = set()
    for batch in batches:
        rep, digest, out = [], [], []
        for lo, _, buf, off in tv.chunks(batch.column(1)):
            for i, x in enumerate(shingle_sets(buf, off)):
                own = (batch.column(0)[lo + i].as_py(), _digest(items := x.tobytes()))
                if len(x) and own not in seen:
                    seen.add(own)
                    out.append(items)
                    rep.append(own[0])
                    digest.append(own[1])
        yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(digest, pa.binary()), pa.array(out, pa.binary())], names=["rep", "digest", "items"])


def _check(percent: int):
    def run(batches):
        """From (u, salt, m, items) in order of u, salt, centre first: the confirmed links (u, v)."""
        at, centre = None, None
        for batch in batches:
            us, vs = [], []
            for u, salt, m, items in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if m == u:
                    at, centre = (u, salt), np.frombuffer(items.as_py(), np.uint64)
                elif at == (u, salt):
                    x = np.frombuffer(items.as_py(), np.uint64)
                    if 100 * min(len(x), len(centre)) >= percent * max(len(x), len(centre)):
                        place = np.minimum(np.searchsorted(centre, x), len(centre) - 1)
                        both = int((centre[place] == x).sum())
                        if 100 * both >= percent * (len(x) + len(centre) - both):
                            us.append(u)
                            vs.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of a written table that are links, on full sets."""
    pairs = pairs.select("u", "v")
    degree = table(pairs.groupBy("u").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SALT_PAIRS).cast("long").alias("salts")), "degree")
    members = hot_join(pairs, degree, "u", "n", pairs.count()).select("u", F.pmod(F.xxhash64("v"), "salts").alias("salt"), F.col("v").alias("m"))
    centres = degree.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("u").alias("m"))
    rows = _with_sets(docs, classes, members.union(centres)).select("u", "salt", "m", "items")
    return rows.repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("m") != F.col("u")).mapInArrow(_check(percent), "u long, v long")


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, hot_bucket: int = HOT_BUCKET, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Confirmed links that connect all linked classes: (u, v), numbers of classes."""
    sketch = classes.select(F.col("cid").alias("v"), F.col("sketch").alias("sv"))
    hot = hot_buckets(classes, classes.count(), hot_bucket)
    keys = classes.select("cid", "n", "bands").mapInArrow(_keys(hot), "key long, salt long, v long, n long")
    multi = table(keys.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "v").mapInArrow(_stars(percent), "key long, v long, n long, u long"), "buckets")
    ties = multi.where("u <> v").select("u", "v").distinct()
    ties = ties.join(sketch, "v").join(sketch.select(F.col("v").alias("u"), F.col("sv").alias("su")), "u").select("u", "v", "su", "sv").mapInArrow(_screen, "u long, v long, k long")
    best = table(ties.groupBy("v").agg(F.max(F.struct("k", (-F.col("u")).alias("u"))).alias("b")).select((-F.col("b.u")).alias("u"), "v"), "ties")
    one = table(verified(docs, classes, best, percent), "links")
    comp = components(one, "u", "v")
    # round two: families across components in the buckets that still hold more than one
    marked = table(multi.select("key", "n", "v").join(comp.select(F.col("id").alias("v"), "component"), "v", "left").select("key", "n", "v", F.coalesce("component", "v").alias("c")), "marked")
    mixed = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("key", "members", F.ceil(F.col("members") / cell_rows).cast("int").alias("groups"))
    rows = hot_join(marked, table(mixed, "mixed"), "key", "members", marked.count(), hot_rows=hot_bucket)
    rows = rows.withColumn("g", F.pmod(F.xxhash64("v"), "groups").cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    rows = rows.select("key", F.least("g", "s").alias("a"), F.greatest("g", "s").alias("b"), "g", "n", "v", "c").join(sketch, "v").select("key", "a", "b", "g", "n", "v", "c", "sv")
    near = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "n", "v").mapInArrow(_forest(percent), "u long, v long")
    family = table(components(near, "u", "v").join(classes.select(F.col("cid").alias("id"), "n", "sketch"), "id").join(comp.withColumnRenamed("component", "c"), "id", "left").select(F.col("id").alias("m"), F.col("component").alias("family"), F.coalesce("c", "id").alias("c"), "n", "sketch"), "families")
    return one.union(_within(docs, classes, family, percent, block_bytes))


def _within(docs: DataFrame, classes: DataFrame, family: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links across components within families (m, family, c, n, sketch)."""
    size = table(family.groupBy("family").agg(F.count("*").alias("members"), F.ceil(F.sum("n") * 8 / block_bytes).cast("int").alias("groups")), "sizes")
    total = family.count()
    cells = hot_join(family, size, "family", "members", total).withColumn("g", F.pmod(F.xxhash64("m"), "groups").cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    cells = cells.select("m", "family", F.least("g", "s").alias("a"), F.greatest("g", "s").alias("b"), "g", "c", "sketch")
    rows = _with_sets(docs, classes, cells).select("family", "a", "b", "g", "m", "c", "sketch", "items")
    return rows.repartition("family", "a", "b").sortWithinPartitions("family", "a", "b").mapInArrow(_cells(percent), "u long, v long")


def _with_sets(docs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (m, ..) with the set of class m as items. Texts stay where they are while the rows are few enough to be broadcast."""
    rows = table(rows.join(classes.select(F.col("cid").alias("m"), "rep", "digest"), "m"), "need")
    small = (lambda x: F.broadcast(x)) if rows.count() * ROW_BYTES <= BROADCAST_BYTES else (lambda x: x)
    sets = docs.select("doc_id", "text").join(small(rows.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").mapInArrow(_sets, "rep long, digest binary, items binary")
    return sets.join(small(rows), ["rep", "digest"])


def _one_node(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between the classes of each doc_id that has several."""
    many = some.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi").select("doc_id")
    own = table(some.select("doc_id", "digest").join(many, "doc_id", "left_semi").distinct().join(classes.select("digest", "cid"), "digest").select("doc_id", "cid"), "shared")
    hub = table(own.groupBy("doc_id").agg(F.min("cid").alias("hub"), F.count("*").alias("n")), "hubs")
    return hot_join(own, hub, "doc_id", "n", own.count()).where("cid <> hub").select(F.col("hub").alias("u"), F.col("cid").alias("v"))


def groups(docs: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, hot_bucket: int = HOT_BUCKET, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    docs, _ = plain(docs, ["doc_id", "text"], keep=[])
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = table(src.mapInArrow(_signed, "doc_id long, n long, digest binary, bands binary, sketch binary"), "signed")
    some = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    edges = links(src, classes, percent, block_bytes, hot_bucket, cell_rows).union(_one_node(some, classes))
    found = table(components(edges, "u", "v").join(classes.select(F.col("cid").alias("id"), "rep"), "id"), "found")
    least = table(found.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n")), "least")
    joined = hot_join(found, least, "component", "n", found.count()).select(F.col("id").alias("cid"), "least")
    of = table(classes.select("digest", "cid", "rep", "members").join(joined, "cid", "left").select("digest", F.coalesce("least", "rep").alias("component"), "members"), "of")
    rows = signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    # an empty row is one node with what else has its doc_id
    empty = signed.where(F.col("digest").isNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    twins = table(signed.join(empty, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("digest").alias("twin"), F.count("*").alias("total")).where(F.col("twin").isNotNull()), "twins")
    if not twins.isEmpty():
        rows = table(hot_join(rows, twins, "doc_id", "total", rows.count(), "left").select("doc_id", "n", F.coalesce("digest", "twin").alias("digest")), "rows")
    out = hot_join(rows, of, "digest", "members", rows.count(), "left")
    node = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), node.alias("component_id"), F.coalesce(F.col("doc_id") == node, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that are the least of their group. docs should be a written table; it is read several times."""
    docs, back = plain(docs, ["doc_id", "text"])
    gone = groups(docs, percent).where(~F.col("kept")).select("doc_id")
    return back(docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns))
