"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all non-ASCII
characters; normalised text is words joined by one space. Patterns are all windows of
``size`` consecutive words of an item (an item of fewer words, but not none, is one
window), with a space at both ends so that only whole words match. A text's words in
any occurrence of a pattern are hit; spans of hit words are mapped back to code-point
offsets in the original text.

The automaton is built from at most ``MAX_WINDOWS`` (window, item) pairs, which bounds
what is broadcast and what a worker holds. Of a larger benchmark only the windows that
may occur matter: one pass over the texts probes the 64-bit hash of every run of words of a
window's length against all windows' hashes (``MAX_HASHES`` a pass), and the windows it met go on. Those
are split by hash into as many blocks as it takes; each block scans all texts and the
blocks' hits are united by row, so results depend neither on the probe nor on the number of blocks.

Defined results: a null or empty text has no words and isn't contaminated; items with
null id or no words match nothing; items that share an id are one item; repeated rows
are documents of their own; an empty benchmark hits nothing; columns of docs named like
a result (in any case) are replaced by it, all others kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textvec as tv
from .runtime import plain, table

MAX_WINDOWS = 20_000
MAX_HASHES = 1 << 22
_FOLD = np.uint64(0x9E3779B97F4A7C15 | 5)
RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")]
    + [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
)
_SEP = 1  # stands between rows in a normalised chunk; no word has it


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's rows as ' w1 w2 .. wn ' with a separator before each row, one character a byte; starts of words in buf, ends, first word of each row."""
    s, e, wp = tv.words(buf, off)
    n = len(s)
    # each word is copied behind a space; a row adds its separator and its last space
    length = e - s
    row = np.repeat(np.arange(len(off) - 1), np.diff(wp))
    begin = np.concatenate([[0], np.cumsum(length + 1)])[:-1] + 2 * row + 2 if n else np.zeros(0, np.int64)  # of the word's first byte
    out = np.full(int(length.sum()) + n + 2 * (len(off) - 1) + 1, 32, np.uint8)
    isw = tv.ALNUM[buf]
    at = np.repeat(begin - s, length) + np.flatnonzero(isw)
    out[at] = tv.LOWER[buf[isw]]
    first = np.concatenate([[0], np.cumsum(length + 1)])[wp[:-1]] + 2 * np.arange(len(off) - 1)
    out[first] = _SEP
    return out.tobytes().decode("latin-1"), begin, e, wp


def folded(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words from the words' hashes."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:k].copy()
    for j in range(1, n):
        acc *= _FOLD
        acc += h[j : j + k]
    return tv.mix(acc + np.uint64(n))


def windows(bench: DataFrame, size: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct (window, item, n, hash): every window of every item, normalised, with its number of words."""

    def run(batches):
        for batch in batches:
            win, ids, sizes, hashes = [], [], [], []
            for _id, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                b = np.frombuffer(t.as_py() or b"", np.uint8)
                s, e, _ = tv.words(b, np.array([0, len(b)]))
                low = tv.LOWER[b].tobytes()
                w = [low[i:j] for i, j in zip(s, e)]
                if w and _id is not None:
                    n = min(size, len(w))
                    h = folded(tv.hashes(b, s, e), n).view(np.int64).tolist()
                    own = {b" ".join(w[i : i + n]): x for i, x in enumerate(h)}
                    win += own
                    hashes += own.values()
                    ids += [_id] * len(own)
                    sizes += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(win, pa.binary()), pa.array(ids, pa.string()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], names=["window", "item", "n", "hash"])

    bench, _ = plain(bench, [item, text], keep=[])
    return bench.select(F.col(item).cast("string"), F.col(text)).mapInArrow(run, "window binary, item string, n int, hash long").distinct()


def _met(shared):
    """Hashes of a text column's runs of words that are among the sorted ones of ``shared``: [(n, hashes)]."""

    def run(batches):
        probes = []
        for n, known in shared.value:
            bits = np.zeros(1 << 21, np.uint8)  # 2 ** 24 bits spare nearly all searches
            at = (known >> np.uint64(40)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            probes.append((n, known, bits))
        seen: set[int] = set()
        for batch in batches:
            out = set()
            for _, _, buf, off in tv.chunks(batch.column(0)):
                s, e, wp = tv.words(buf, off)
                h, last = tv.hashes(buf, s, e), np.repeat(wp[1:], np.diff(wp))
                for n, known, bits in probes:
                    w = folded(h, n)
                    at = (w >> np.uint64(40)).astype(np.int64)
                    w = w[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (np.arange(len(w)) + n <= last[: len(w)])]
                    place = np.minimum(np.searchsorted(known, w), len(known) - 1)
                    out.update(w[known[place] == w].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out - seen), pa.int64())], names=["hash"])
            seen |= out  # at most the hashes of a pass

    return run


def _occurring(docs: DataFrame, wins: DataFrame, max_hashes: int) -> DataFrame:
    """The windows of a written table that may occur in some text."""
    spark, found = docs.sparkSession, None
    keys = table(wins.select("n", "hash").distinct(), "hashes")
    blocks = max(1, -(-keys.count() // max_hashes))
    for k in range(blocks):
        rows = keys.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == k).toArrow()
        n, h = rows.column("n").to_numpy(), rows.column("hash").to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast([(int(x), np.sort(h[n == x])) for x in np.unique(n)])
        part = docs.select("text").mapInArrow(_met(shared), "hash long").distinct()
        found = part if found is None else found.union(part)
    return table(wins.join(table(found, "met"), "hash", "left_semi"), "occurring")


class Matcher:
    """An automaton over (window, item) pairs and the scan of a text column with it."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        import ahocorasick

        by: dict[bytes, list[str]] = {}
        for w, i in pairs:
            by.setdefault(bytes(w), []).append(i)
        self.auto = ahocorasick.Automaton()
        for w, items in by.items():
            self.auto.add_word(" " + w.decode("latin-1") + " ", (w.count(b" ") + 1, items))
        self.empty = not by
        self.auto.make_automaton()

    def rows(self, buf: np.ndarray, off: np.ndarray):
        """For each row: words, merged runs of hit words, matched items; and the words' bounds in buf."""
        text, begin, e, wp = normalised(buf, off)
        runs: dict[int, list] = {}
        items: dict[int, set] = {}
        if not self.empty and len(begin):
            found = list(self.auto.iter(text))
            if found:
                last = np.searchsorted(begin, np.array([x for x, _ in found]), "left") - 1  # the word before the final space
                for w, (_, (n, own)) in zip(last.tolist(), found):
                    r = int(np.searchsorted(wp, w, "right")) - 1
                    a = w - n + 1 - int(wp[r])
                    mine = runs.setdefault(r, [])
                    mine.append((a, a + n))
                    items.setdefault(r, set()).update(own)
        return wp, {r: merge(x) for r, x in runs.items()}, items, e


def merge(runs: list) -> list[tuple[int, int]]:
    """Sorted runs without overlap."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _result(n_words: int, runs: list, items, spans: list) -> tuple:
    hit = sum(b - a for a, b in runs)
    return n_words, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and 20 * hit >= n_words, spans


def _spans(text: bytes, runs: list) -> list[dict]:
    """Code-point offsets of runs of words of one text."""
    if not runs:
        return []
    b = np.frombuffer(text, np.uint8)
    s, e, _ = tv.words(b, np.array([0, len(b)]))
    points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return [{"start": int(points[s[a]]), "end": int(points[e[z - 1]])} for a, z in runs]


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = 13, max_windows: int = MAX_WINDOWS, max_hashes: int = MAX_HASHES) -> DataFrame:
    """All columns of docs and RESULT's: words, hit words, items that occur, their ids' hash, whether a twentieth of the words is hit, and the hit spans."""
    docs, back = plain(docs, ["text"], RESULT.names)
    wins = table(windows(bench, size), "windows")
    if wins.count() > max_windows:
        wins = _occurring(docs, wins, max_hashes)
    blocks = max(1, -(-wins.count() // max_windows))
    names = docs.columns
    schema = T.StructType(docs.schema.fields + RESULT.fields)
    text = names.index("text")
    take = lambda k: [(bytes(r[0]), r[1]) for r in wins.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k).select("window", "item").collect()]
    if blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast(take(0))

        def run(batches):
            match = Matcher(shared.value)
            for batch in batches:
                texts, rows = batch.column(text), []
                for lo, hi, buf, off in tv.chunks(texts):
                    wp, runs, items, _ = match.rows(buf, off)
                    for r in range(hi - lo):
                        mine = runs.get(r, [])
                        rows.append(_result(int(wp[r + 1] - wp[r]), mine, items.get(r, ()), _spans(buf[off[r] : off[r + 1]].tobytes(), mine)))
                yield _batch(batch, len(names), rows, schema)

        return back(docs.mapInArrow(run, schema))

    rows = table(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    hits = None
    for k in range(blocks):
        hit = rows.select("row", "text").mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(take(k))), "row long, runs array<long>, items array<string>")
        hits = hit if hits is None else hits.union(hit)
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # a text's hits, from each block once

    def finish(batches):
        for batch in batches:
            out = []
            for t, runs, items in zip(batch.column(text).cast(pa.large_binary()), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                t = t.as_py() or b""
                b = np.frombuffer(t, np.uint8)
                mine = merge(list(zip(runs[::2], runs[1::2]))) if runs else []
                out.append(_result(len(tv.words(b, np.array([0, len(b)]))[0]), mine, items or (), _spans(t, mine)))
            yield _batch(batch, len(names), out, schema)

    return back(rows.join(hits, "row", "left").select(*names, "runs", "items").mapInArrow(finish, schema))


def _scan(shared):
    def run(batches):
        match = Matcher(shared.value)
        for batch in batches:
            ids, out = batch.column(0), ([], [], [])
            for lo, _, buf, off in tv.chunks(batch.column(1)):
                _, runs, items, _ = match.rows(buf, off)
                for r, mine in runs.items():
                    out[0].append(ids[lo + r].as_py())
                    out[1].append([x for p in mine for x in p])
                    out[2].append(sorted(items[r]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.string()))], names=["row", "runs", "items"])

    return run


def _batch(batch, own: int, rows, schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in RESULT]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return pa.RecordBatch.from_arrays(batch.columns[:own] + [pa.array(list(c), k) for c, k in zip(cols, kinds)], names=schema.names)
