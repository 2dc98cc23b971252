"""Toxicity: a subword bag averaged into a linear softmax, trained jointly in numpy.

A word's features are itself and its character n-grams (``<word>``, 3 to 5 bytes of
lower-cased UTF-8), hashed into ``BUCKETS`` rows of an embedding; a document is the
mean of all its features; a softmax layer over the mean gives the two classes.
Embedding and softmax are learned together by full-batch Adam. Since everything
after the embedding is linear, scoring needs one number for each bucket (embedding
times the difference of the class weights): a table of fixed size that goes to the
workers in the task closure, and whole texts of any length are scored in one scan.

Training uses a bounded sample (``MAX_TRAIN`` documents of class 1, twice as many of class 0, at most
``MAX_TRAIN_BYTES`` of text in all, least hash of doc_id first); scoring covers
every row. Nothing but the text is an input of a score.

Defined results: a null or empty text, or one without words, has the score of the
bare bias; duplicate rows are scored each; no labels at all gives score 0.5 * base;
extra columns are ignored. Labels that are null are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textvec as tv
from .runtime import plain

BUCKETS = 1 << 16
DIM = 6
NGRAMS = (3, 4, 5)
MAX_TRAIN = 1000  # of class 1; twice as many of class 0
MAX_TRAIN_BYTES = 8 << 20
STEPS = 120
RATE = 0.03
DECAY = 1e-4
MIN_Z = 5.0
SCALE = 100.0
SEED = 7
CACHE_BITS = 19


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all words, and each word's first index in them (one entry more than words)."""
    buf = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8)
    ends = np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    starts = ends - np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner, which = [np.arange(len(words))], [tv.hashes(buf, starts, ends)]
    of = np.repeat(np.arange(len(words)), ends - starts)
    for n in NGRAMS:
        s = np.arange(max(0, len(buf) - n + 1))
        s = s[of[s] == of[s + n - 1]] if len(s) else s
        s = s[~((starts[of[s]] == s) & (ends[of[s]] == s + n))]  # the whole word is there already
        owner.append(of[s])
        which.append(tv.hashes(buf, s, s + n))
    owner, which = np.concatenate(owner), np.concatenate(which)
    order = np.argsort(owner, kind="stable")
    ptr = np.searchsorted(owner[order], np.arange(len(words) + 1))
    return (which[order] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), ptr


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """One number for each bucket, and the bias; the log-odds of class 1 are bias + mean of the features' numbers.

    The vocabulary: buckets whose document share differs between the classes by ``MIN_Z``
    standard errors or more, whatever their number and the sample's size; the others keep the zero vector.
    """
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        p = (labels.sum() + 0.5) / (len(labels) + 1)
        return np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p)))
    seen, df = [], np.zeros((2, BUCKETS))
    for text, y in zip(texts, labels):
        data, off = tv.binary(pa.array([text], pa.large_string()))
        s, e, _ = tv.words(data, off)
        low = tv.LOWER[data].tobytes()
        count = np.bincount(features([low[i:j] for i, j in zip(s.tolist(), e.tolist())])[0], minlength=BUCKETS) if len(s) else np.zeros(BUCKETS, np.int64)
        at = np.flatnonzero(count)
        seen.append((at, (count[at] / max(1, count.sum())).astype(np.float32)))
        df[y, at] += 1
    n = np.bincount(labels, minlength=2)[:, None]
    share = df / n
    pooled = (df.sum(0) + 1) / (n.sum() + 2)
    z = (share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n).sum())
    used = np.flatnonzero(np.abs(z) >= MIN_Z)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    rows, cols, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for i, (at, v) in enumerate(seen):
        k = place[at]
        rows.append(np.full((k >= 0).sum(), i))
        cols.append(k[k >= 0])
        values.append(v[k >= 0] * np.float32(SCALE))  # the mean of many features is short
    rows, cols, values = (np.concatenate(v) for v in (rows, cols, values))
    by_row, by_col = _sums(rows, len(texts)), _sums(cols, len(used))
    rng = np.random.RandomState(SEED)
    emb, w, b = (rng.standard_normal((len(used), DIM)) * 0.01).astype(np.float32), (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32)
    y = np.eye(2, dtype=np.float32)[labels]
    weight = (len(labels) / (2 * n[:, 0]))[labels][:, None].astype(np.float32) / len(labels)
    state = [(np.zeros_like(a), np.zeros_like(a)) for a in (emb, w, b)]
    for step in range(1, STEPS + 1):
        mean = by_row(values[:, None] * emb[cols])
        o = mean @ w + b
        p = np.exp(o - o.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - y) * weight
        grads = (by_col(values[:, None] * (g @ w.T)[rows]) + DECAY * emb, mean.T @ g + DECAY * w, g.sum(0))
        for a, d, (m, v) in zip((emb, w, b), grads, state):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            a -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    table = np.zeros(BUCKETS, np.float32)
    table[used] = SCALE * (emb @ (w[:, 1] - w[:, 0]))
    return table, float(b[1] - b[0])


def _sums(key: np.ndarray, n: int):
    """The function that sums rows by their key in 0 .. n - 1."""
    order = np.argsort(key, kind="stable")
    some, first = np.unique(key[order], return_index=True)

    def run(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, x.shape[1]), np.float32)
        if len(some):
            out[some] = np.add.reduceat(x[order], first, axis=0)
        return out

    return run


class Scorer:
    """Scores Arrow string columns; a word's sums are cached by its hash."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.cache = tv.HashCache(CACHE_BITS)
        self.value = np.zeros((self.cache.slots, 2), np.float64)

    def logits(self, col: pa.Array) -> np.ndarray:
        out = np.empty(len(col))
        for lo, hi, buf, off in tv.chunks(col):
            s, e, wp = tv.words(buf, off)
            h = tv.hashes(buf, s, e)
            slot, hit = self.cache.find(h)
            value = self.value[slot]
            miss = np.flatnonzero(~hit)
            if len(miss):
                new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
                low = tv.LOWER[buf].tobytes()
                sums = np.empty((len(new), 2))
                for a in range(0, len(new), 1 << 15):  # bounds what the features take
                    words = [low[s[i] : e[i]] for i in miss[first[a : a + (1 << 15)]]]
                    feat, fp = features(words)
                    sums[a : a + len(words), 0] = np.add.reduceat(self.table[feat].astype(np.float64), fp[:-1])
                    sums[a : a + len(words), 1] = np.diff(fp)
                value[miss] = sums[back]
                at = (new >> self.cache.shift).astype(np.int64)
                self.cache.keys[at], self.value[at] = new, sums
                # of several new words for a slot the last stays; keys and values agree as both take the last
            c = np.concatenate([np.zeros((1, 2)), np.cumsum(value, axis=0)])
            d = c[wp[1:]] - c[wp[:-1]]
            out[lo:hi] = d[:, 0] / np.maximum(d[:, 1], 1) + self.bias
        return out


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts: at most ``max_rows`` documents of class 1 and twice as many of class 0, least hash of doc_id first, at most ``max_bytes`` of text, whole texts only: one that doesn't fit what is left of its class's half is passed over."""
    docs, labels = plain(docs, ["doc_id", "text"], keep=[])[0], plain(labels, ["doc_id", label], keep=[])[0]
    h = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    ids, texts, out = {}, [], []
    for k in (0, 1):
        rows = labels.where(F.col(label) == k).select("doc_id").distinct().orderBy(h, "doc_id").limit(max_rows * (2 - k)).collect()
        ids |= {r[0]: k for r in rows}
    if not ids:
        return [], []
    # one text an id, so that repeated rows don't add up; the bound is applied to sizes before any text comes to the driver
    wanted = lambda some: docs.where(F.col("doc_id").isin(some) & F.col("text").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text"))
    room, take = max_bytes // 2, {}
    size = {r[0]: r[1] for r in wanted(list(ids)).select("doc_id", F.octet_length("text")).collect()}
    left = {0: room, 1: room}
    for i, k in ids.items():
        if i in size and size[i] <= left[k]:
            left[k] -= size[i]
            take[i] = k
    for i, t in wanted(list(take)).orderBy("doc_id").collect():
        texts.append(t)
        out.append(take[i])
    return texts, out


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id; one named score is replaced) and score, the probability of class 1."""
    table, bias = model
    docs, back = plain(docs, ["text"], ["score"], keep or ["doc_id"])
    own = [c for c in docs.columns if c != "text" or "text" in (keep or ())]
    read = own if "text" in own else [*own, "text"]
    at = read.index("text")

    def run(batches):
        scorer = Scorer(table, bias)
        for b in batches:
            p = 1 / (1 + np.exp(-np.clip(scorer.logits(b.column(at)), -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array(p)], names=[*own, "score"])

    return back(docs.select(*read).mapInArrow(run, T.StructType([*[docs.schema[c] for c in own], T.StructField("score", T.DoubleType())])))


def fit(docs: DataFrame, labels: DataFrame, held_out=None) -> tuple[np.ndarray, float]:
    """Learns ``labels.toxic`` from the rows of which ``held_out`` isn't true."""
    if held_out is not None:
        labels = labels.where(~held_out)  # a null doc_id is in neither
    return train(*sample(docs, labels, "toxic"))
