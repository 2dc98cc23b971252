"""Training-order materialisation: packed sequences in a keyed random order, in fixed-stride shards.

Sequences are numbered without gaps (each task's and group's count, summed up), and a keyed
Feistel network over the next even power of two, with cycle-walking back into the
range, permutes the numbers: every sequence has one global slot, and no two share one, without a
sort or a table of the order. ``slot_of`` and ``number_of`` are inverse to each other, so
any position of a run can be found again from the key.

Slot s is row s % rows of shard s // rows. A task gathers its sequences by shard, compresses
each gathering as one block and shuffles the blocks; a range of shards, as many as it takes to have at most
``TASKS`` ranges or the session's number of shuffle partitions, is a task. One shard after the other it puts each sequence in
its place in a buffer of fixed size and writes the file once, under a temporary name that
is then moved, so a repeated task leaves the same file. Shards are ``shard-000000.bin`` with
rows of ``size`` ids (zeros after a shorter sequence), lengths are in ``shard-000000.len``
(32-bit), and ``manifest.json`` says how to read them; read() goes on from any slot.

What is collected is a count for each task that packed. Defined results: those of packing
(null text is the final id alone, repeated rows count each); an empty table gives no
shards and no rows; ids that don't fit the type raise ValueError; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .packing import WINDOW, pack
from .runtime import table

ROWS = 8192
TYPE = "<u2"
ROUNDS = 6
KEY = 0x5EED
BLOCK_ROWS = 1024
TASKS = 4096


def _keys(key: int) -> np.ndarray:
    return tv.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask, w = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> w, x & mask
    for k in keys:
        left, right = right, left ^ (tv.mix(right + k) & mask)
    return (right << w) | left  # sides swapped, so that the reversed keys invert it


def _walk(x: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    x = _network(x, half, keys)
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = _network(x[out], half, keys)
    return x.astype(np.int64)


def slot_of(number, n: int, key: int = KEY) -> np.ndarray:
    """The slots, in 0 .. n - 1, of numbers in 0 .. n - 1: a bijection for each key."""
    return _walk(number, n, _keys(key))


def number_of(slot, n: int, key: int = KEY) -> np.ndarray:
    return _walk(slot, n, _keys(key)[::-1])


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _write(path: str, name: str, data) -> None:
    f, root = _filesystem(path)
    f.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
    with f.open_output_stream(temporary) as out:
        out.write(data)
    f.move(temporary, f"{root}/{name}")


def materialise(docs: DataFrame, path: str, tokenizer: str, ranks: str | None = None, size: int = WINDOW, key: int = KEY, rows: int = ROWS, type: str = TYPE, tasks: int = TASKS) -> DataFrame:
    """Writes the shards to ``path``, a folder that all executors share, and returns (sequence_id, slot, shard, position, n_tokens, ids_crc32), a row for each sequence."""
    import zstandard

    spark = docs.sparkSession
    sequences = pack(docs, tokenizer, ranks, size, whole=type)  # a written table and its small last step, which gives the same rows each time
    part = F.shiftright("sequence_id", 32)  # below 0 for the groups of leftovers
    counts = sequences.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    parts, base = np.array([r[0] for r in counts], np.int64), np.cumsum([0, *[r[1] for r in counts]])
    n = int(base[-1])
    stride, item = size * np.dtype(type).itemsize, np.dtype(type).itemsize

    def gather(batches):
        held: dict[int, list] = {}
        level = zstandard.ZstdCompressor(level=3)

        def block(shard):
            ids, slots, lengths, raw = zip(*held.pop(shard))
            return shard, np.array(ids, np.int64).tobytes(), np.array(slots, np.int64).tobytes(), np.array(lengths, np.int32).tobytes(), level.compress(b"".join(raw))

        def out(blocks):
            kinds = [pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks), kinds)], names=["shard", "ids", "slots", "lengths", "data"])

        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            seq = batch.column(0).to_numpy()
            # within a task or group numbers count up from 0, also below 0
            low = np.where(seq >= 0, seq & 0xFFFFFFFF, 0xFFFFFFFF - (seq & 0xFFFFFFFF))
            slot = slot_of(base[np.searchsorted(parts, seq >> 32)] + low, n, key)
            for i, s, k, raw in zip(seq.tolist(), slot.tolist(), batch.column(1).to_pylist(), batch.column(2)):
                held.setdefault(s // rows, []).append((i, s, k, raw.as_py()))
                count += 1
            if count >= BLOCK_ROWS * 16:  # about 64 MB
                for s in sorted(held):
                    yield out([block(s)])
                count = 0
        for s in sorted(held):
            yield out([block(s)])

    def write(batches):
        plain = zstandard.ZstdDecompressor()
        shard = buffer = lengths = crcs = ids = None

        def done():
            k = min(rows, n - shard * rows)
            _write(path, f"shard-{shard:06d}.bin", memoryview(buffer)[: k * stride])
            _write(path, f"shard-{shard:06d}.len", lengths[:k].astype("<i4").tobytes())
            slots = shard * rows + np.arange(k)
            return pa.RecordBatch.from_arrays([pa.array(ids[:k]), pa.array(slots), pa.array(np.full(k, shard)), pa.array(np.arange(k)), pa.array(lengths[:k]), pa.array(crcs[:k])], names=["sequence_id", "slot", "shard", "position", "n_tokens", "ids_crc32"])

        for batch in batches:
            for s, i, at, k, data in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    if shard is not None:
                        yield done()
                    shard, buffer = s, bytearray(rows * stride)
                    lengths, crcs, ids = (np.zeros(rows, np.int64) for _ in range(3))
                raw, offset = plain.decompress(data), 0
                for sequence, slot, length in zip(np.frombuffer(i, np.int64).tolist(), np.frombuffer(at, np.int64).tolist(), np.frombuffer(k, np.int32).tolist()):
                    p = slot - s * rows
                    own = raw[offset : offset + length * item]
                    buffer[p * stride : p * stride + len(own)] = own
                    lengths[p], ids[p], crcs[p] = length, sequence, zlib.crc32(np.frombuffer(own, type).astype("<u4").tobytes())
                    offset += length * item
        if shard is not None:
            yield done()

    blocks = sequences.select("sequence_id", "length", "ids").mapInArrow(gather, "shard long, ids binary, slots binary, lengths binary, data binary")
    shards = max(1, -(-n // rows))
    tasks = min(shards, max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = blocks.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("shard").mapInArrow(write, "sequence_id long, slot long, shard long, position long, n_tokens long, ids_crc32 long")
    written = table(out, "order")  # the files are written once, before anyone reads
    _write(path, "manifest.json", json.dumps({"sequences": n, "size": size, "rows": rows, "type": type, "key": key, "shards": -(-n // rows)}).encode())
    return written


def read(path: str, slot: int = 0, count: int | None = None):
    """Yields the ids of the sequences from a slot on, in order: one seek, then sequential reads."""
    f, root = _filesystem(path)
    with f.open_input_stream(f"{root}/manifest.json") as m:
        about = json.loads(m.read())
    end = about["sequences"] if count is None else min(about["sequences"], slot + count)
    stride = about["size"] * np.dtype(about["type"]).itemsize
    while slot < end:
        shard, at = divmod(slot, about["rows"])
        stop = min(about["rows"], at + end - slot)
        with f.open_input_file(f"{root}/shard-{shard:06d}.len") as x:
            x.seek(4 * at)
            lengths = np.frombuffer(x.read(4 * (stop - at)), "<i4")
        with f.open_input_file(f"{root}/shard-{shard:06d}.bin") as x:
            x.seek(stride * at)
            for k in lengths.tolist():
                yield np.frombuffer(x.read(stride), about["type"])[:k]
        slot += stop - at
