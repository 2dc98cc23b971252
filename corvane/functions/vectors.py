"""Vectors as arrays: cosine and normalisation in built-in functions, hashed n-gram embeddings over Arrow batches."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import words
from corvane.functions.tokenize import split_identifier

DIM = 384
GRAMS = (3, 4, 5, 6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Over the common prefix; 0 if either is zero there."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def grams(token: Column) -> Column:
    """All 3- to 6-grams of a token's first 256 characters, lower case, repeats kept."""
    t = F.substring(F.lower(token), 1, 256)
    make = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: t.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[make(n) for n in GRAMS])


def slot(gram: Column) -> Column:
    return (F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long") % DIM).cast("int")


#: products of a word and its slots that are summed at once; words whose slots are found at once, and grams that are hashed at once
PRODUCTS, WORDS, HASHED = 1 << 22, 1 << 15, 1 << 14
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]


def _md5(x: np.ndarray, n: int) -> np.ndarray:
    """The first 32 bits of the md5 of texts of n < 8 bytes, each the low bytes of a number: hashlib costs ten times as much a gram."""
    x = x | np.uint64(0x80 << (8 * n))
    text = {0: x.astype(np.uint32), 1: (x >> np.uint64(32)).astype(np.uint32), 14: 8 * n}
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(x), v) for v in start)
    for i in range(64):
        f, g = [(lambda: d ^ (b & (c ^ d)), i), (lambda: c ^ (d & (b ^ c)), 5 * i + 1), (lambda: b ^ c ^ d, 3 * i + 5), (lambda: c ^ (b | ~d), 7 * i)][i // 16]
        m = text.get(g % 16, 0)
        t = a + f() + (np.uint32((_SINES[i] + m) % 2**32) if isinstance(m, int) else m + np.uint32(_SINES[i]))
        a, b, c, d = d, b + ((t << np.uint32(_TURNS[i])) | (t >> np.uint32(32 - _TURNS[i]))), b, c
    return (a + start[0]).byteswap()


def _slots(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, hits, slots): of each word the number of its grams and of the slots that one hits; and these, word by word."""
    data = pa.concat_arrays([names])
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) if len(data) else np.zeros(1, np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    size = np.minimum(np.diff(offsets), 256)
    other = np.flatnonzero(~pa.compute.string_is_ascii(data).to_numpy(zero_copy_only=False))  # grams of characters, not of bytes
    size[other] = 0
    grams = sum(np.maximum(size - n + 1, 0) for n in GRAMS)
    hits, slots = np.zeros(len(data), np.int64), []
    for lo in range(0, len(data), WORDS):
        hi = min(lo + WORDS, len(data))
        hit = np.zeros((hi - lo) * DIM, bool)
        for n in GRAMS:
            k = np.maximum(size[lo:hi] - n + 1, 0)
            at, own = words.spread(offsets[lo:hi], k), np.repeat(np.arange(hi - lo) * DIM, k)
            for j in range(0, len(at), HASHED):
                some = at[j : j + HASHED]
                x = functools.reduce(np.bitwise_or, (raw[some + i] << np.uint64(8 * i) for i in range(n)))
                hit[own[j : j + HASHED] + _md5(x, n) % DIM] = True
        for w in other[(other >= lo) & (other < hi)]:
            t = data[int(w)].as_py().lower()[:256]
            g = [t[i : i + n] for n in GRAMS for i in range(len(t) - n + 1)]
            grams[w] = len(g)
            for x in g:
                hit[(w - lo) * DIM + int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "big") % DIM] = True
        hits[lo:hi] = hit.reshape(-1, DIM).sum(axis=1)
        slots.append((np.flatnonzero(hit) % DIM).astype(np.int32))
    return grams, hits, np.concatenate(slots) if slots else np.zeros(0, np.int32)


def _sums(column: pa.Array) -> np.ndarray:
    """A row of DIM sums for each text or list of words: of every word the number of times by the number of its grams, in each of its slots."""
    row, word, names = words.of_lists(column) if pa.types.is_list(column.type) else words.of_text(column)
    out = np.zeros(len(column) * DIM)
    row, word, n, _ = words.counted(row, word, max(1, len(names)))
    grams, hits, every = _slots(names)
    starts = np.cumsum(hits) - hits
    size = np.cumsum(hits[word]) // PRODUCTS
    ends = [*(np.flatnonzero(np.diff(size)) + 1).tolist(), len(word)]
    for lo, hi in zip([0, *ends], ends):
        if lo == hi:
            continue
        r, w, k = row[lo:hi], word[lo:hi], hits[word[lo:hi]]
        at = np.repeat((r - r[0]) * DIM, k) + every[words.spread(starts[w], k)]
        part = np.bincount(at, np.repeat(n[lo:hi] / np.maximum(grams[w], 1), k), (r[-1] - r[0] + 1) * DIM)
        out[r[0] * DIM : (r[-1] + 1) * DIM] += part
    return out.reshape(-1, DIM)


def _packed(sums: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * DIM), len(sums), [None, pa.py_buffer(sums.tobytes())]).cast(pa.binary())


def _summed(batches):
    """(id, part, sums) of (id, column, ..): a row for each column that has a word with a gram."""
    for batch in batches:
        for c in range(1, batch.num_columns):
            for piece in words.slices(batch, c):
                sums = _sums(piece.column(c))
                some = np.flatnonzero(sums.any(axis=1))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(some)), pa.array(np.full(len(some), c, np.int32)), _packed(sums[some])], names=["id", "part", "sums"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _runs(changes: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.flatnonzero(changes), axis=0)


def _finished(batches, columns: int):
    """(id, slot, weight) of (id, part, sums), sorted: rows of one id and part are one vector, and an id's vectors have a mean. The last id of a batch waits for the next one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        last = np.flatnonzero(_changes(table.column(0)))[-1]
        if last:
            yield from _weights(table.slice(0, last), columns)
        held = table.slice(last)
        if len(held) > 4096:  # many texts of one id: what is summed takes their place
            _, places, sums = _parts(held)
            held = pa.RecordBatch.from_arrays([held.column(0).take(pa.array(places)), held.column(1).take(pa.array(places)), _packed(sums)], schema=held.schema)
    if held is not None:
        yield from _weights(held, columns)


def _changes(ids: pa.Array) -> np.ndarray:
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def _parts(batch: pa.RecordBatch):
    """(changes of the id, places of rows, sums) of each id and part."""
    raw = batch.column(2)
    lo, hi = (int(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset + k]) for k in (0, len(raw)))
    sums = np.frombuffer(raw.buffers()[2], np.float64, (hi - lo) // 8, lo).reshape(-1, DIM)
    new = _changes(batch.column(0))
    part = batch.column(1).to_numpy()
    both = new | np.concatenate([[True], part[1:] != part[:-1]])
    return new[both], np.flatnonzero(both), _runs(both, sums)


def _weights(batch: pa.RecordBatch, columns: int):
    new, places, sums = _parts(batch)
    mean = _unit(sums)
    if columns > 1:
        mean = _unit(_runs(new, mean))
    ids, (r, slot) = batch.column(0).take(pa.array(places[new])), np.nonzero(mean)
    for k in range(0, len(r), 1 << 17):
        i, s = r[k : k + (1 << 17)], slot[k : k + (1 << 17)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(s.astype(np.int32)), pa.array(mean[i, s])], names=["id", "slot", "weight"])


def _embed(texts: DataFrame) -> DataFrame:
    """(id, slot, weight), of length 1, from (id, column, ..) with texts or lists of words: an id's mean of its columns' vectors.

    A row's vector needs no other row, so it is made where the row is read; only sums, 384 doubles a row, are brought together by id. The factor by the number of tokens cancels in the normalisation.
    """
    kind = texts.schema["id"].dataType.simpleString()
    sums = texts.mapInArrow(_summed, f"id {kind}, part int, sums binary")
    return sums.repartition("id").sortWithinPartitions("id", "part").mapInArrow(functools.partial(_finished, columns=len(texts.columns) - 1), f"id {kind}, slot int, weight double")


def embed_text(texts: DataFrame, id: str, text: str) -> DataFrame:
    """Sparse embeddings of texts. Texts without a token of three characters have no row (the zero vector)."""
    return embed_texts(texts, id, [text])


def embed_texts(texts: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """embed_document() of the columns' embeddings, in one pass."""
    return _embed(texts.select(F.col(id).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]))


def embed_identifier(names: DataFrame, id: str, name: str) -> DataFrame:
    """Sparse embeddings of identifiers: the whole and each of its parts."""
    n = F.col(name)
    return _embed(names.select(F.col(id).alias("id"), F.transform(F.concat(F.array(n), split_identifier(n)), F.lower).alias("tokens")))


def embed_document(parts: list[DataFrame]) -> DataFrame:
    """The mean of component embeddings, each (id, part, slot, weight), of length 1."""
    raw = functools.reduce(DataFrame.unionByName, parts).groupBy("id", "slot").agg(F.sum("weight").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # of at most DIM rows
    return raw.select("id", "slot", (F.col("w") / norm).alias("weight"))


def dense(sparse: DataFrame) -> DataFrame:
    """(id, vector) with all slots from (id, slot, weight)."""
    m = F.map_from_entries(F.collect_list(F.struct("slot", "weight")))  # at most DIM entries
    return sparse.groupBy("id").agg(m.alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vector"))
