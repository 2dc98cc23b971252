"""Packing: bounded-space online packing of token sequences into windows of a fixed length.

Each task keeps at most ``OPEN`` open windows. A document's ids (and its final id) first
fill whole windows of their own; what remains goes into the open window that it fits
best. If it fits none it opens a window, and if all are open the fullest is completed
with the remainder's head (documents may be cut anywhere) and emitted. At a task's end
the open windows are merged, again by cutting, and so leave less than one window; these
leftovers of up to ``MERGE`` tasks at a time are merged into windows in a last small
step. What a group then leaves is cut into sequences whose lengths are powers of two,
which need no padding. So no sequence has any padding, whatever the input.

Ids come from a vocabulary file of the tokenizers library. Where a file of the same
vocabulary's ranks is given, the faster tiktoken encodes those texts for which the two
libraries are known to split alike: all characters have had their class since Unicode 3.2,
the text has no special token's string, and no run of ``LONG_RUN`` white-space characters (on which
tiktoken's pattern recurses until its stack is full). The others go through tokenizers itself.

The first step is written to the shared folder, so each document is encoded once, and a
task that is repeated gives the same rows. Sequence ids are (task, number) from 0 up, and
below 0 for the last step.

Defined results: a null or empty text is the final id alone; repeated rows are packed
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .runtime import plain, table

WINDOW = 2048
FINAL = 1
OPEN = 64
MERGE = 1024
LONG_RUN = 1 << 15
_loaded: dict = {}


def _safe() -> np.ndarray:
    """Characters of the basic plane that both libraries are sure to class alike."""
    if "safe" not in _loaded:
        old, ok = unicodedata.ucd_3_2_0, np.zeros(1 << 16, bool)
        for c in range(1 << 16):
            a, b = old.category(chr(c)), unicodedata.category(chr(c))
            ok[c] = a == b and a not in ("Cn", "Cs", "Co")
        ok[[0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = False
        _loaded["safe"] = ok
    return _loaded["safe"]


class Encoder:
    def __init__(self, tokenizer: str, ranks: str | None = None):
        self.tokenizer, self.fast, self.exact = tokenizer, None, None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and not _long_run(text) and (text.isascii() and not any("\x1c" <= c <= "\x1f" for c in set(text)) or self._sure(text)) and "<|" not in text:
            return self.fast.encode_ordinary(text)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.tokenizer)
        return self.exact.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _sure(text: str) -> bool:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return bool(c.max(initial=0) < 1 << 16 and _safe()[c].all())


def _long_run(text: str, most: int = LONG_RUN) -> bool:
    """Whether the text has a run of ``most`` white-space characters; one of under half of that never counts. Such a run covers two neighbouring multiples of its half, so few characters are looked at."""
    half = most // 2
    spaces = [text[i].isspace() for i in range(0, len(text), half)] if len(text) >= half else []
    return any(a and b and text[i * half : (i + 1) * half].isspace() for i, (a, b) in enumerate(zip(spaces, spaces[1:])))


def encoder(tokenizer: str, ranks: str | None) -> Encoder:
    """One for each worker and vocabulary."""
    if (tokenizer, ranks) not in _loaded:
        _loaded[tokenizer, ranks] = Encoder(tokenizer, ranks)
    return _loaded[tokenizer, ranks]


class Packer:
    """The open windows of a task. put() and close() return finished windows, each a list of pieces (doc, start, ids, doc's ids)."""

    def __init__(self, size: int = WINDOW, most: int = OPEN):
        self.size, self.most = size, most
        self.open: list[list] = []  # [free, pieces]

    def put(self, doc, ids: np.ndarray) -> list[list]:
        n, at, done = len(ids), 0, []
        while n - at >= self.size:
            done.append([(doc, at, ids[at : at + self.size], n)])
            at += self.size
        while at < n:
            need = n - at
            best = min((w for w in self.open if w[0] >= need), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                best = [self.size, []]
                self.open.append(best)
            if best is None:
                best = min(self.open, key=lambda w: w[0])  # the fullest
                need = best[0]
            best[1].append((doc, at, ids[at : at + need], n))
            best[0] -= need
            at += need
            if not best[0]:
                self.open = [w for w in self.open if w is not best]
                done.append(best[1])
        return done

    def close(self) -> tuple[list[list], list]:
        """The open windows merged: full windows, and the pieces that are left."""
        left = [p for _, pieces in sorted(self.open, key=lambda w: w[0]) for p in pieces]
        self.open = []
        return merged(left, self.size)


def merged(pieces: list, size: int = WINDOW) -> tuple[list[list], list]:
    """Pieces laid end to end and cut every ``size`` ids: full windows, and what is left."""
    done, now, free = [], [], size
    for doc, start, ids, n in pieces:
        at = 0
        while at < len(ids):
            k = min(free, len(ids) - at)
            now.append((doc, start + at, ids[at : at + k], n))
            at += k
            free -= k
            if not free:
                done.append(now)
                now, free = [], size
    return done, now


def powers(pieces: list) -> list[list]:
    """Pieces laid end to end and cut into runs whose lengths are powers of two, the longest first."""
    left, done = sum(len(p[2]) for p in pieces), []
    while left:
        k = 1 << (left.bit_length() - 1)
        first, rest = merged(pieces, k)
        done.append(first[0])
        pieces = [p for w in first[1:] for p in w] + rest
        left -= k
    return done


def _schema(doc: T.DataType) -> T.StructType:
    longs = lambda *n: [T.StructField(x, T.LongType()) for x in n]
    return T.StructType([T.StructField("doc_id", doc), *longs("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), T.StructField("ids", T.BinaryType()), T.StructField("part", T.LongType())])


class _Rows:
    """Gathers pieces as columns; ids are little-endian unsigned 32-bit."""

    def __init__(self, schema: T.StructType, doc: pa.DataType):
        self.names, self.doc, self.cols = schema.names, doc, [[] for _ in schema]

    def window(self, pieces: list, sequence: int, keep_ids: bool, whole: str | None = None) -> None:
        """A row for each piece, or with ``whole`` (a type of ids) one row with all ids and the number of pieces."""
        if whole:
            ids = np.concatenate([p[2] for p in pieces])
            if ids.max(initial=0) > np.iinfo(whole).max:
                raise ValueError(f"id {ids.max()} doesn't fit {whole}")
            for c, v in zip(self.cols, (None, 0, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(pieces), sequence, 0, ids.astype(whole).tobytes(), None)):
                c.append(v)
            return
        offset = 0
        for doc, start, ids, n in pieces:
            raw = ids.astype("<u4").tobytes()
            for c, v in zip(self.cols, (doc, start, len(ids), zlib.crc32(raw), n, sequence, offset, raw if keep_ids else None, None)):
                c.append(v)
            offset += len(ids)

    def left(self, pieces: list, part: int) -> None:
        for i, (doc, start, ids, n) in enumerate(pieces):
            for c, v in zip(self.cols, (doc, start, len(ids), None, n, None, i, ids.astype("<u4").tobytes(), part)):
                c.append(v)

    def out(self) -> pa.RecordBatch:
        kinds = [self.doc] + [pa.int64()] * 6 + [pa.binary(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.cols, kinds)], names=self.names)
        self.cols = [[] for _ in self.cols]
        return batch


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = WINDOW, final: int = FINAL, open_windows: int = OPEN, keep_ids: bool = False, whole: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``keep_ids`` also ids (binary).

    With ``whole``, a type such as ``<u2``, a row for each sequence instead: sequence_id, length, ids_crc32, ids of that type.
    """
    docs, _ = plain(docs, ["doc_id", "text"], keep=[])
    schema = _schema(docs.schema["doc_id"].dataType)

    def run(batches):
        part = TaskContext.get().partitionId()
        encode, packer, rows, n, kind = encoder(tokenizer, ranks), Packer(size, open_windows), None, part << 32, None
        for batch in batches:
            kind = batch.schema.field(0).type
            rows = rows or _Rows(schema, kind)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode.ids(text.as_py() or ""), final], np.uint32)
                for w in packer.put(doc, ids):
                    rows.window(w, n, keep_ids, whole)
                    n += 1
                if len(rows.cols[0]) >= 4096 or (keep_ids or whole) and len(rows.cols[0]) >= 512:
                    yield rows.out()
        if rows:
            done, left = packer.close()
            for w in done:
                rows.window(w, n, keep_ids, whole)
                n += 1
            rows.left(left, part)
            yield rows.out()

    first = table(docs.select("doc_id", "text").mapInArrow(run, schema), "packed")

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("offset", "ascending")])
        g = group.column("part")[0].as_py() // MERGE
        get = lambda c: group.column(c).to_pylist()
        pieces = [(d, s, np.frombuffer(b, "<u4"), k) for d, s, b, k in zip(get("doc_id"), get("start"), get("ids"), get("doc_tokens"))]
        done, left = merged(pieces, size)
        rows = _Rows(schema, group.column("doc_id").type)
        for i, w in enumerate(done + powers(left)):
            rows.window(w, -1 - (g << 32) - i, keep_ids, whole)
        return pa.Table.from_batches([rows.out()])

    # a group is at most MERGE leftovers, each shorter than a window
    last = first.where(F.col("part").isNotNull()).groupBy(F.floor(F.col("part") / MERGE).alias("g")).applyInArrow(merge, schema)
    if whole:
        cols = ["sequence_id", "length", "ids_crc32", "ids"]
        return first.where(F.col("part").isNull()).select(*cols).union(last.select(*cols))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return first.where(F.col("part").isNull()).select(*cols).union(last.select(*cols))
