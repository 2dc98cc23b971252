"""Line dedup: lines whose key occurs in many documents go, found through two Bloom filters.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.

1. Every task puts the 64-bit hashes of its keys, once for each document, into a
   *once* filter and those it meets again into a *twice* filter. Both leave the task
   as sorted bit positions by shard of the filter, and are merged shard by shard in one
   streaming pass: ``twice |= twice' | (once & once')``, ``once |= once'``. Position lists
   are streamed in sorted order, so a merging task holds one bit array of a shard.
   The twice filter has no false negatives: a key of two documents is always in it.
2. Only keys in the twice filter ("suspected repeats") are shuffled, as 128-bit
   digests with counts that are already summed within the task, for an exact count.
3. Keys with at least ``min_docs`` documents are dropped everywhere, or everywhere but
   at their first occurrence (least doc_id, then line) with ``keep="first"``.

The filter's size follows the input's size on disk and is bounded by ``MAX_BITS``; past
that, false positives send more keys to the exact count, and results stay the same.
The dropped keys are broadcast as digests where their counted number is at most
``MAX_BROADCAST_KEYS``. Beyond it lines that pass the twice filter are joined with them by digest, one row
for each document and key; digests with more than a ``runtime.HOT_SHARE``-th of these rows are broadcast, as they can only be few,
and the others are shuffled. Both ways give equal results.

A full filter (``MAX_BITS`` fills up at about a billion distinct lines) lets every key through: then all keys
are counted exactly, as digests of 16 bytes that are summed within tasks first, so what is shuffled
stays below the texts' own size.

Defined results: a null or empty text is one empty line; a key shorter than
``min_length`` code points never drops; repeated rows are documents of their own; an
empty table gives an empty result; other columns are kept as they are, but those named like a result (in any case) are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textvec as tv
from .runtime import HOT_ROWS, hot_join, plain, table

MAX_BITS = 1 << 31
MIN_BITS = 1 << 22
SHARD_BITS = 1 << 22
MAX_BROADCAST_KEYS = 1 << 18
LENGTH_OF_DIGEST = 16
_STRIP = b" \t\n\x0b\x0c\r"
_LOWER = bytes(tv.LOWER)


def keys(text: bytes) -> list[bytes]:
    """The keys of a text's lines."""
    return [x.strip(_STRIP) for x in text.translate(_LOWER).split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines of the rows, stripped, and each row's first line index."""
    solid = np.append(tv.SOLID[buf], True)
    cut = np.flatnonzero(buf == 10)
    row_start = off[:-1]
    # a line begins at a row's start and after each newline of the row
    s = np.concatenate([row_start, cut + 1])
    row = np.concatenate([np.arange(len(row_start)), np.searchsorted(off, cut, "right") - 1])
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    e = np.empty_like(s)
    e[:-1] = np.where(row[1:] == row[:-1], s[1:] - 1, off[row[:-1] + 1])
    if len(e):
        e[-1] = off[-1]
    # next solid byte at or after the start; last solid byte before the end
    at = np.flatnonzero(solid)
    a = at[np.searchsorted(at, s)]
    k = np.searchsorted(at, e) - 1
    b = np.where(k >= 0, at[np.maximum(k, 0)] + 1, 0)
    empty = a >= e
    a, b = np.where(empty, s, a), np.where(empty, s, b)
    return a, b, np.searchsorted(row, np.arange(len(off)))


def _hashed(buf, off) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b, lp = _lines(buf, off)
    return a, b, lp, tv.hashes(buf, a, b)


def _once_a_row(h: np.ndarray, lp: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Indexes of the first line with each hash within each row, of those in use."""
    row = np.repeat(np.arange(len(lp) - 1), np.diff(lp))
    order = np.lexsort((h, row))
    order = order[use[order]]
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    return order[new]


def _usable(a, b, buf, least: int) -> np.ndarray:
    if least <= 1:
        return b - a >= least
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return points[b] - points[a] >= least


def _pack(bits: np.ndarray) -> bytes:
    return np.diff(bits, prepend=bits.dtype.type(0)).astype(np.uint32).tobytes() if len(bits) else b""


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32), dtype=np.int64)


def twice_filter(docs: DataFrame, min_length: int, bits: int) -> np.ndarray:
    """The packed twice filter of all keys of the documents, ``bits`` long (a power of two)."""
    shards = max(1, bits // SHARD_BITS)
    per = bits // shards
    shift = np.uint64(64 - bits.bit_length() + 1)
    block = 1 << 18  # keys gathered before the filters are put out

    def local(batches):
        held: list[np.ndarray] = []
        n = 0

        def out():
            p, c = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for s in range(shards):
                lo, hi = np.searchsorted(p, [s * per, (s + 1) * per])
                if hi > lo:
                    q = p[lo:hi] - s * per
                    rows.append((s, _pack(q), _pack(q[c[lo:hi] > 1])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "once", "twice"])

        for batch in batches:
            for _, _, buf, off in tv.chunks(batch.column(0)):
                a, b, lp, h = _hashed(buf, off)
                at = _once_a_row(h, lp, _usable(a, b, buf, min_length))
                held.append((h[at] >> shift).astype(np.int64))
                n += len(at)
                if n >= block:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def merged(batches):
        shard, once, twice = -1, np.zeros(0, bool), np.zeros(0, bool)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["shard", "twice"])

        for batch in batches:
            for s, o, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if s != shard:
                    if shard >= 0:
                        yield out()
                    shard, once, twice = s, np.zeros(per, bool), np.zeros(per, bool)
                p = _unpack(o.as_py())
                twice[p[once[p]]] = True
                twice[_unpack(t.as_py())] = True
                once[p] = True
        if shard >= 0:
            yield out()

    parts = docs.select("text").mapInArrow(local, "shard int, once binary, twice binary")
    done = parts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merged, "shard int, twice binary")
    found = np.zeros(bits // 8, np.uint8)
    for s, data in done.toLocalIterator():  # bits / 8 bytes in all, MAX_BITS / 8 at most
        found[s * per // 8 : (s + 1) * per // 8] = np.frombuffer(bytes(data), np.uint8)
    return found


def filter_bits(docs: DataFrame) -> int:
    """Bits of the filters: about the bytes that the plan's files hold, in bounds. Where a plan doesn't know its size, its texts are measured."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << min(MAX_BITS.bit_length() - 1, max(MIN_BITS.bit_length() - 1, (size // 4).bit_length()))


def suspected(docs: DataFrame, min_length: int = 1, bits: int | None = None):
    """The twice filter as a broadcast, and the shift that leads from a key's hash to its bit."""
    bits = bits or filter_bits(docs)
    return docs.sparkSession.sparkContext.broadcast(twice_filter(docs, min_length, bits)), np.uint64(64 - bits.bit_length() + 1)


def repeated_keys(docs: DataFrame, min_docs: int = 10, min_length: int = 1, bits: int | None = None, first: bool = False, filters=None) -> DataFrame:
    """(digest, n_docs[, first]): keys found in at least ``min_docs`` documents; first is (doc_id, line) of the first occurrence. filters: what suspected() gave."""
    suspects, shift = filters or suspected(docs, min_length, bits)
    ids = docs.schema["doc_id"].dataType if first else T.LongType()
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType())] + [T.StructField("doc", ids), T.StructField("line", T.LongType())] * first)

    def candidates(batches):
        filt = suspects.value
        counts: dict[bytes, list] = {}

        def out():
            cols = [pa.array(list(counts), pa.binary()), pa.array([c[0] for c in counts.values()], pa.int64())]
            if first:
                cols += [pa.array([c[1] for c in counts.values()], batch.schema.field(1).type), pa.array([c[2] for c in counts.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for batch in batches:
            for lo, _, buf, off in tv.chunks(batch.column(0)):
                a, b, lp, h = _hashed(buf, off)
                bit = (h >> shift).astype(np.int64)
                at = _once_a_row(h, lp, _usable(a, b, buf, min_length) & (filt[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool))
                low = tv.LOWER[buf].tobytes()
                rows = np.searchsorted(lp, at, "right") - 1 if first else at
                for i, r in zip(at.tolist(), rows.tolist()):
                    d = hashlib.blake2b(low[a[i] : b[i]], digest_size=LENGTH_OF_DIGEST).digest()
                    c = counts.get(d)
                    if c is None:
                        c = counts[d] = [0, None, None]
                    c[0] += 1
                    if first:
                        doc, line = batch.column(1)[lo + r].as_py(), i - int(lp[r])
                        if doc is not None and (c[1] is None or (doc, line) < (c[1], c[2])):
                            c[1], c[2] = doc, line
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    part = docs.select("text", *["doc_id"] * first).mapInArrow(candidates, schema)
    agg = [F.sum("n").alias("n_docs")] + [F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "line"))).alias("first")] * first
    return table(part.groupBy("digest").agg(*agg).where(F.col("n_docs") >= min_docs), "lines")


OUT = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]


def line_dedup(docs: DataFrame, min_docs: int = 10, min_length: int = 1, keep: str = "none", bits: int | None = None, max_broadcast: int = MAX_BROADCAST_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All columns of docs with the text after dropping, and n_lines (before), n_dropped. ``keep="first"`` spares the first occurrence."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    first = keep == "first"
    docs, back = plain(docs, ["text", *["doc_id"] * first], [f.name for f in OUT])
    filters = suspected(docs, min_length, bits)
    found = repeated_keys(docs, min_docs, min_length, bits, first, filters)
    n = found.count()
    return back(_drop_by_broadcast(docs, found, min_length, first) if n <= max_broadcast else _drop_by_join(docs, found, min_length, first, filters, hot_rows))


def _drop_by_broadcast(docs, found, least, first):
    rows = found.collect()
    spare = {bytes(r["digest"]): tuple(r["first"]) if first and r["first"] is not None else None for r in rows}
    shared = docs.sparkSession.sparkContext.broadcast(spare)
    schema = T.StructType(docs.schema.fields + OUT)
    names = docs.columns

    def run(batches):
        gone = shared.value
        dig = hashlib.blake2b
        for batch in batches:
            text, ids = batch.schema.get_field_index("text"), batch.schema.get_field_index("doc_id")
            texts, total, dropped = [], [], []
            for i, t in enumerate(batch.column(text).cast(pa.large_binary())):
                t = t.as_py() or b""
                ks, parts = keys(t), None
                if gone:
                    for j, k in enumerate(ks):
                        if _long_enough(k, least) and (d := dig(k, digest_size=LENGTH_OF_DIGEST).digest()) in gone and not (first and gone[d] == (batch.column(ids)[i].as_py(), j)):
                            if parts is None:
                                parts = [True] * len(ks)
                            parts[j] = False
                total.append(len(ks))
                dropped.append(0 if parts is None else len(ks) - sum(parts))
                texts.append(t if parts is None else b"\n".join(x for x, p in zip(t.split(b"\n"), parts) if p))
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if f == "text" else batch.column(batch.schema.get_field_index(f)) for f in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def _drop_by_join(docs, found, least, first, filters, hot_rows):
    """Documents' suspected keys join the dropped ones by digest."""
    suspects, shift = filters
    rows = table(docs.withColumn("row", F.monotonically_increasing_id()), "rows")

    def lines(batches):
        filt = suspects.value
        for batch in batches:
            row, digest, at = [], [], []
            for lo, hi, buf, off in tv.chunks(batch.column(1)):
                a, b, lp, h = _hashed(buf, off)
                bit = (h >> shift).astype(np.int64)
                use = np.flatnonzero(_usable(a, b, buf, least) & (filt[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool))
                low = tv.LOWER[buf].tobytes()
                own: dict[tuple[int, bytes], list[int]] = {}
                for i, r in zip(use.tolist(), (np.searchsorted(lp, use, "right") - 1).tolist()):
                    own.setdefault((r, hashlib.blake2b(low[a[i] : b[i]], digest_size=LENGTH_OF_DIGEST).digest()), []).append(i - int(lp[r]))
                for (r, d), x in own.items():
                    row.append(batch.column(0)[lo + r].as_py())
                    digest.append(d)
                    at.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(digest, pa.binary()), pa.array(at, pa.list_(pa.int64()))], names=["row", "digest", "lines"])

    each = table(rows.select("row", "text").mapInArrow(lines, "row long, digest binary, lines array<long>"), "suspects")
    hit = hot_join(each, found, "digest", "n_docs", each.count(), hot_rows=hot_rows)
    if first:
        spared = F.when(F.col("first.doc").eqNullSafe(F.col("doc_id")) & F.col("doc_id").isNotNull(), F.array("first.line")).otherwise(F.array().cast("array<long>"))
        hit = hit.join(rows.select("row", "doc_id"), "row").withColumn("lines", F.array_except("lines", spared))
    gone = hit.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))  # at most the lines of a document
    names, schema = docs.columns, T.StructType(docs.schema.fields + OUT)

    def drop(batches):
        at = names.index("text")
        for batch in batches:
            texts, total, dropped = [], [], []
            for t, out in zip(batch.column(at).cast(pa.large_binary()), batch.column(len(names)).to_pylist()):
                parts = (t.as_py() or b"").split(b"\n")
                out = set(out or ())
                texts.append(b"\n".join(x for i, x in enumerate(parts) if i not in out))
                total.append(len(parts))
                dropped.append(len(out))
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return rows.join(gone, "row", "left").select(*names, "gone").mapInArrow(drop, schema)
