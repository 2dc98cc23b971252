r"""Secret scans with corpus-wide ownership frequency.

*Base* kinds, leftmost non-overlapping for each kind, code-point offsets, end exclusive:
``assign`` ``(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)``
(names in either ASCII case, value of 6 or more), ``access`` ``AKIA[A-Z0-9]+`` (20 or
more), ``hex`` ``[0-9a-f]+`` (24 or more). Matches that are too short drop.

*Method*: candidates of the base kinds and of further kinds (``vendor``: tokens with
well-known prefixes; ``opaque``: long mixed tokens) are hashed, and for every hash the
whole corpus is aggregated into documents, distinct repositories and distinct owners.
A value looks live if at most ``live_owners`` owners have it, in at most ``live_repos`` repositories (two an owner); others
are widely copied examples, even where a single owner spread them. Spans of the further kinds are reported
only where their value looks live and none of them lies in a base span.

What shuffles is (hash, repository, owner) after distinct within each task; a hash in a
third of all rows is one row for each repository in a task, and its distinct owners and
repositories are counted in two levels, so no group is gathered in one task.
Verdicts return to documents by a join on the hash with the *live* values alone, each of
which is in few owners; examples, the hot ones, never join. A value that one owner
repeats in very many documents is live and hot: its rows are spread by salt.

Defined results: null text is empty; null repository or owner counts as one own name;
repeated rows are documents of their own; columns of docs named like a result (in any case) are
replaced, all others kept.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .runtime import plain, table

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
VENDOR = re.compile(rb"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*)")
OPAQUE = re.compile(rb"[A-Za-z0-9+/_-]{32,}")
_HEX_RUN = re.compile(rb"[0-9a-f]{24,}")  # the leftmost maximal runs of 24 or more are those of HEX
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "vendor", "opaque")
_SALTS = 16


def find(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in bytes, sorted: base spans and further candidates outside them."""
    base = [(m.start(), 0, m.end(), *m.span(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if b"=" in text or b":" in text else []
    if b"AKIA" in text:
        base += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end(), *m.span()) for m in _HEX_RUN.finditer(text)]
    more = [(m.start(), 3, m.end(), *m.span()) for m in VENDOR.finditer(text)]
    more += [(m.start(), 4, m.end(), *m.span()) for m in OPAQUE.finditer(text) if _mixed(m.group())]
    if more:
        free = _clear([x for x in more if x[1] == 3], base)
        more = free + _clear([x for x in more if x[1] == 4], base + free)
    return sorted(base + more)


def _clear(spans: list, others: list) -> list:
    """The spans that overlap none of the others, found by their merged cover."""
    cover: list[list[int]] = []
    for s, e in sorted((x[0], x[2]) for x in others):
        if cover and s < cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], e)
        else:
            cover.append([s, e])
    starts = [c[0] for c in cover]

    def free(s, e):
        i = bisect.bisect_left(starts, e) - 1  # the last that begins before the span's end
        return i < 0 or cover[i][1] <= s

    return [x for x in spans if free(x[0], x[2])]


def _mixed(token: bytes) -> bool:
    """Digits, upper and lower case: words of prose aren't."""
    return any(48 <= c < 58 for c in token) and any(65 <= c < 91 for c in token) and any(97 <= c < 123 for c in token)


_CAND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary())]))
_CAND_T = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("hash", T.BinaryType())]))


def candidates(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.cast(pa.large_binary()):
        t = t.as_py() or b""
        row = []
        if found := find(t):
            points = None if t.isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
            for s, kind, e, vs, ve in found:
                a, b = (s, e) if points is None else (int(points[s]), int(points[e]))
                row.append({"kind": kind, "start": a, "end": b, "hash": hashlib.blake2b(t[vs:ve], digest_size=16).digest()})
        out.append(row)
    return pa.array(out, _CAND)


def ownership(cands: DataFrame) -> DataFrame:
    """(hash, n_docs, n_repos, n_owners) over (hash, repo, owner, n): every level sums within tasks first; the distinct level spreads a hot hash over repositories and owners."""
    pairs = cands.groupBy("hash", "repo", "owner").agg(F.sum("n").alias("n"))
    repos = pairs.groupBy("hash", "repo").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_repos"))
    owners = pairs.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "hash")


_VERDICT = ("n_docs", "n_repos", "n_owners")
_RESULT = [
    *[T.StructField(f"n_{k}", T.LongType()) for k in BASE],
    *[T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")],
    *[T.StructField(c, T.LongType()) for c in ("n_live", "n_example")],
    T.StructField("live", T.ArrayType(T.StructType([T.StructField("span", T.StringType()), *[T.StructField(c, T.LongType()) for c in _VERDICT]]))),
]
_KINDS = [*[pa.int64()] * 3, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("span", pa.string()), *[(c, pa.int64()) for c in _VERDICT]]))]


def scan(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, live_owners: int = 1, live_repos: int | None = None) -> DataFrame:
    """All columns of docs but text, n_assign, n_access, n_hex, base_sha256, spans (all, as kind:start:end), n_live and n_example (of all candidates), live: (span, n_docs, n_repos, n_owners) of values that look live. repo and owner default to the column source, or a row of its own where there is none."""
    live_repos = 2 * live_owners if live_repos is None else live_repos
    made = [f.name for f in _RESULT]
    has_source = any(c.lower() == "source" for c in docs.columns)
    given = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    asked = ["corvane repo", "corvane owner"]
    docs = docs.select("*", given(repo), given(owner)).toDF(*docs.columns, *asked)
    docs, back = plain(docs, ["text", *asked, *["source"] * has_source], made)
    src = F.col("source").cast("string") if has_source else F.monotonically_increasing_id().cast("string")
    named = lambda c, own: F.coalesce(F.col(own) if c is not None else src, F.lit("\0null"))
    docs = docs.withColumns({"repo": named(repo, asked[0]), "owner": named(owner, asked[1])}).drop(*asked)
    rest = [c for c in docs.columns if c not in ("text", "repo", "owner")]
    schema = T.StructType([*[docs.schema[c] for c in (*rest, "repo", "owner")], T.StructField("cand", _CAND_T)])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], candidates(batch.column(batch.num_columns - 1))], names=schema.names)

    rows = table(docs.select(*rest, "repo", "owner", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.where(F.size("cand") > 0).select("row", "repo", "owner", F.explode("cand").alias("c"))
    seen = each.select(F.col("c.hash").alias("hash"), "repo", "owner", "row").distinct().groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    live = table(ownership(seen).where((F.col("n_owners") <= live_owners) & (F.col("n_repos") <= live_repos)), "live").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    spread = each.select("row", F.col("c.hash").alias("hash")).distinct().withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(_SALTS)).cast("int"))
    alive = spread.join(live.hint("merge"), ["hash", "salt"]).groupBy("row").agg(F.collect_list(F.struct("hash", *_VERDICT)).alias("alive"))  # hashes of one document
    out = T.StructType([*[docs.schema[c] for c in rest], *_RESULT])

    def finish(batches):
        for batch in batches:
            n = len(rest)
            made = [_row(cand or (), alive or ()) for cand, alive in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            cols = list(zip(*made)) if made else [[] for _ in _RESULT]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(list(c), k) for c, k in zip(cols, _KINDS))], names=out.names)

    # texts stay out of tables and joins
    return back(rows.join(alive, "row", "left").select(*rest, "cand", "alive").mapInArrow(finish, out))


def _row(cand: list, alive: list) -> tuple:
    """A document's results from its candidates and the verdicts on its live values."""
    verdict = {bytes(x["hash"]): {v: x[v] for v in _VERDICT} for x in alive}
    cand = sorted(cand, key=lambda c: (c["start"], c["kind"], c["end"]))
    show = [f"{KINDS[c['kind']]}:{c['start']}:{c['end']}" for c in cand]
    found = [verdict.get(bytes(c["hash"])) for c in cand]
    base = [c["kind"] < len(BASE) for c in cand]
    counts = [sum(c["kind"] == k for c in cand) for k in range(len(BASE))]
    sha = hashlib.sha256(",".join(x for x, b in zip(show, base) if b).encode()).hexdigest()
    live = [{"span": x, **f} for x, f in zip(show, found) if f]
    return (*counts, sha, ",".join(x for x, b, f in zip(show, base, found) if b or f), len(live), len(cand) - len(live), live)
