"""Each operator against its plain version, on a table with every awkward case."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from corvane.llm import decontam, embdup, licenses, linededup, neardup, packing, queries, quality, runtime, secrets, textvec, toxicity, trainorder


def table(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_words_and_hashes_match_regex(rows):
    import pyarrow as pa

    texts = [t for _, t in rows]
    got, by = [], {}
    for lo, hi, buf, off in textvec.chunks(pa.array(texts), 1 << 12):
        s, e, wp = textvec.words(buf, off)
        for h, a, b in zip(textvec.hashes(buf, s, e), s, e):
            w = buf[a:b].tobytes().decode().translate(brute.LOW)
            assert by.setdefault(w, h) == h
        got += [[buf[a:b].tobytes().decode().translate(brute.LOW) for a, b in zip(s[i:j], e[i:j])] for i, j in zip(wp[:-1], wp[1:])]
    assert got == [brute.words(t) for t in texts]
    assert len(set(by.values())) == len(by)
    assert textvec.hash_word("One") == textvec.hash_word("one") != textvec.hash_word("One", lower=False)


def test_a_word_longer_than_a_block(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(textvec, "BLOCK", 16)
    textvec._powers.clear()
    (chunk,) = textvec.chunks(pa.array(["a" * 40 + " b " + "c" * 10]))
    s, e, _ = textvec.words(*chunk[2:])
    assert len(set(textvec.hashes(chunk[2], s, e).tolist())) == 3
    monkeypatch.undo()
    textvec._powers.clear()


def test_license_base(docs, rows):
    out = licenses.scan(docs)
    want = Counter((d, *brute.base_licenses(t)) for d, t in rows)
    assert table(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert set(docs.columns) - {"n_words", "score", "labels"} <= set(out.columns)


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: the base columns of op1 and op10, of which the methods' own columns have no SQL
LICENSE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
place AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
hit AS (SELECT doc_id, i - 1 AS i, label FROM place, p WHERE w[i : i + len(phrase) - 1] = phrase)
SELECT doc_id, len(w) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM d LEFT JOIN hit USING (doc_id) GROUP BY doc_id, w"""
_FIND = "SELECT doc_id, {k} AS k, unnest(regexp_extract_all(t, '{rx}', {group})) AS v FROM d"
SECRET_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FIND.format(k=0, rx='(?:(?i)password|passwd|secret|token|api_?key(?-i))["' + "''" + ']?\\x20*[:=]\\x20*["' + "''" + ']?([A-Za-z0-9+/_.=-]+)', group=1)} UNION ALL {_FIND.format(k=1, rx='AKIA[A-Z0-9]+', group=0)} UNION ALL {_FIND.format(k=2, rx='[0-9a-f]+', group=0)})
SELECT doc_id, count(*) FILTER (WHERE k = 0 AND length(v) >= 6) AS n_assign, count(*) FILTER (WHERE k = 1 AND length(v) >= 20) AS n_access, count(*) FILTER (WHERE k = 2 AND length(v) >= 24) AS n_hex FROM d LEFT JOIN found USING (doc_id) GROUP BY doc_id"""


@pytest.mark.parametrize("query, sql", [(queries.op1_license_scan, LICENSE_SQL), (queries.op10_secret_scan, SECRET_SQL)])
def test_base_columns_agree_with_sql(spark, query, sql, data="/root/testdata/sf0.01"):
    from pathlib import Path

    import duckdb

    if not Path(data).exists():
        pytest.skip("no data")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    found = c.execute(sql)
    names = [x[0] for x in found.description]
    want = Counter(found.fetchall())
    assert table(query(spark, data), *names) == want and all(any(x[i] for x in want) for i in (1, -1))


def test_license_fuzzy_finds_all_within_the_bound(spark):
    notice, k = "permission is hereby granted free of charge", 4
    r = np.random.RandomState(3)
    texts = []
    for i in range(150):
        s = list(notice)
        for _ in range(r.randint(0, 9)):
            p = r.randint(len(s))
            op = r.randint(3)
            if op == 0:
                s[p] = "q"
            elif op == 1:
                s.insert(p, "z")
            else:
                del s[p]
        texts.append((i, "some words before " + "".join(s) + " and after"))
    out = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), ((notice, "x", k),), {})
    got = {r.doc_id: (r.labels, r.notices) for r in out.collect()}
    for i, t in texts:
        n = brute.edit_distance_anywhere(notice, " ".join(brute.words(t)))
        assert (got[i][0] == "x") == (n <= k), (t, n)
        if n <= k:
            assert min(x.edits for x in got[i][1]) >= n
            a, b = got[i][1][0].start, got[i][1][0].end
            assert brute.edit_distance_anywhere(notice, " ".join(brute.words(t[a:b]))) <= k


def test_license_fuzzy_copies_next_to_an_exact_one_are_all_found(spark):
    exact, near = "released under the mit license", "released undr the mit license"
    lists = {1: [near] * 5 + [exact], 2: [exact] + [near] * 5, 3: [near, near, exact, near, near, exact, near], 4: ([near] * 9 + [exact]) * 40}
    texts = {i: " ".join(x) for i, x in lists.items()} | {5: " ".join(f"word {x} between them " * 2 for x in lists[1])}
    out = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ((exact, "mit", 3),), {})
    for row in out.collect():
        want = lists.get(row.doc_id) or [x for x in lists[1] for _ in range(2)]
        assert [texts[row.doc_id][x.start : x.end] for x in row.notices] == want, row.doc_id
        assert [x.edits for x in row.notices] == [int(x == near) for x in want]


def test_license_spans_are_code_points(spark):
    out = licenses.scan(spark.createDataFrame([(1, "éé ñ Licensed under the Apache Licence, Version 2.0 éé")], "doc_id long, text string")).first()
    spans = [x for x in out.notices if x.label == "apache"]
    assert "éé ñ Licensed under the Apache Licence, Version 2.0 éé"[spans[0].start : spans[0].end].startswith("Licensed under")
    assert out.labels == "apache" and out.base_labels == ""


def test_quality_and_toxicity_learn(spark, folder):
    for query, mod, rest, label in ((queries.op2_quality, 4, 2, "quality"), (queries.op7_toxicity, 5, 0, "toxic")):
        rows = query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").where(f"{label} IS NOT NULL"), "doc_id").collect()
        assert len(rows) == 120 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
        held = [r for r in rows if r.held_out]
        assert sum(r.predicted == r[label] for r in held) >= 0.8 * len(held), label


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    from pathlib import Path

    if not Path(sf).exists():
        pytest.skip("no data")
    for query, label in ((queries.op2_quality, "quality"), (queries.op7_toxicity, "toxic")):
        rows = query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
        assert sum(r.predicted == r[label] for r in rows) >= 0.9 * len(rows), label


def test_quality_scores_are_those_of_plain_sizes(spark, rows):
    """Every score from compressed sizes taken piece by piece, and nothing else: texts without a difference all score the same."""
    import math

    import zstandard

    texts, labels = [t for d, t in rows if d and d >= 1000], [int((d - 1000) % 4 != 1) for d, t in rows if d and d >= 1000]
    model = quality.train(texts, labels)
    dicts = [zstandard.ZstdCompressionDict(x) for x in model.dicts]
    size = lambda t, d: sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d).compress(t[i : i + 128])) for i in range(0, len(t), 128))
    some = [(i, t) for i, (_, t) in enumerate(rows) if i % 7 == 0 or not t]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    for i, t in some:
        raw = (t or "").encode()
        bad, good = (size(raw, d) for d in dicts)
        d = (bad - good) / max(bad, good, 1)
        x = [d, math.tanh(8 * d), math.tanh(30 * d)]
        x += [v * math.log(len(raw) + 16) / 8 for v in x]
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.spread))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), i
    assert len({quality.Model(model.dicts, model.mean, model.spread, model.weights).score(np.array([[n, k, k]]))[0] for n, k in ((0, 0), (50, 40), (10**6, 10**5))}) == 1


@pytest.mark.parametrize("good, bad", [(1, 1), (2, 3), (5, 40), (200, 1)])
def test_quality_learns_from_few_or_uneven_labels(good, bad):
    """Few pieces are raw dictionaries; a class of one or two calibrates on what built its dictionary."""
    r = np.random.RandomState(3)
    text = lambda k: " ".join(r.choice(list("abcdefgh"), 6).astype(object).sum() + k for _ in range(40))
    model = quality.train([text("") for _ in range(good)] + [text("***") for _ in range(bad)], [1] * good + [0] * bad)
    p = model.score(quality.sizes([text("").encode(), text("***").encode(), b""], model.compressors()))
    assert ((0 <= p) & (p <= 1)).all() and (p[0] > p[1] or min(good, bad) < 5)


def test_classifiers_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}


def test_toxicity_cache_gives_what_features_give(rows):
    import pyarrow as pa

    model = toxicity.train([t for d, t in rows if d and d >= 1000], [int((d - 1000) % 3 == 0) for d, t in rows if d and d >= 1000])
    scorer = toxicity.Scorer(*model)
    for _ in range(2):  # cold and warm
        got = scorer.logits(pa.array([t for _, t in rows]))
        for z, (_, t) in zip(got, rows):
            w = [x.encode() for x in brute.words(t)]
            f = toxicity.features(w)[0] if w else np.zeros(0, int)
            assert z == pytest.approx(model[1] + (model[0][f].astype(float).sum() / len(f) if len(f) else 0), abs=1e-6)


def test_toxicity_shares_ngrams_with_misspellings(rows):
    import pyarrow as pa

    model = toxicity.train([t for d, t in rows if d and d >= 1000], [int((d - 1000) % 3 == 0) for d, t in rows if d and d >= 1000])
    clean, odd = toxicity.Scorer(*model).logits(pa.array(["the an or", "the idiott morons"]))
    assert odd > clean


def check_pieces(pieces, rows, size=2048):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(queries.vocabulary()[0])
    want, by, seq = Counter(), defaultdict(list), defaultdict(list)
    for d, t in rows:
        want[d] += len(exact.encode(t or "", add_special_tokens=False).ids) + 1
    for p in pieces:
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    assert {d: sum(p.length for p in v) for d, v in by.items()} == dict(want)
    single = {d: t for d, t in rows if sum(x == d for x, _ in rows) == 1}
    for d, t in single.items():
        ids, at = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(by[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
    padding = 0
    for v in seq.values():
        at = 0
        for p in sorted(v, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


def test_packing(docs, rows):
    check_pieces(packing.pack(docs, *queries.vocabulary()).collect(), rows)
    few = packing.pack(docs, queries.vocabulary()[0], size=64, open_windows=2, keep_ids=True).collect()
    check_pieces(few, rows, 64)
    assert all(len(p.ids) == 4 * p.length for p in few)


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n", "\u00a0", "\u3000", "a", "7"])
@pytest.mark.parametrize("n", [(packing.LONG_RUN // 2) - 1, packing.LONG_RUN, 1_000_000, 5_000_000])
def test_long_runs_of_one_character(run, n):
    if n > 1_000_000 and run not in (" ", "\n"):
        pytest.skip("as the others")
    text = "some words a" + run * (n // len(run)) + "b and more  words"
    e = packing.encoder(*queries.vocabulary())
    fast = e.ids(text)
    assert packing._long_run(text) == (n >= packing.LONG_RUN and run.isspace())
    assert fast == packing.encoder(queries.vocabulary()[0], None).ids(text)


def test_packing_of_long_white_space(spark):
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, "short")]
    check_pieces(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), *queries.vocabulary()).collect(), rows)


def test_packer_keeps_its_bound():
    p, r = packing.Packer(64, 3), np.random.RandomState(0)
    for d in range(300):
        p.put(d, np.arange(r.randint(1, 200), dtype=np.uint32))
        assert len(p.open) <= 3


@pytest.mark.parametrize("bits, most, hot", [(None, 1 << 18, 100_000), (1 << 12, 1 << 18, 100_000), (None, 0, 100_000), (None, 0, 11)])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup(docs, rows, keep, bits, most, hot):
    """By broadcast, with a full filter, by a join, and with some digests hot."""
    out = linededup.line_dedup(docs, 10, 1, keep, bits, most, hot)
    want = brute.line_dedup(rows, 10, keep)
    if keep == "first":  # rows that share an id have the same first occurrence
        assert len(want) == out.count()
    assert table(out, "doc_id", "n_lines", "n_dropped", "text") == Counter(want)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}


def test_line_dedup_counts_code_points(docs, rows):
    out = linededup.line_dedup(docs, 2, 5)
    seen = Counter(k for _, t in rows for k in {brute.key(x) for x in (t or "").split("\n")})
    for r in out.select("text", "n_dropped").collect():
        assert not any(seen[brute.key(x)] >= 2 and len(brute.key(x)) >= 5 for x in r.text.split("\n"))


@pytest.mark.parametrize("windows, hashes", [(decontam.MAX_WINDOWS, decontam.MAX_HASHES), (7, decontam.MAX_HASHES), (50, decontam.MAX_HASHES), (50, 9)])
def test_decontamination(spark, docs, rows, items, windows, hashes):
    """In one block; the probe and blocks; the probe leaves one block; the probe in passes."""
    if windows == 50:
        r = np.random.RandomState(9)
        items = items + [(str(100 + i), " ".join(f"w{x}" for x in r.randint(0, 10**6, 30))) for i in range(20)]
        items = [(i and int(i), t) for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.decontaminate(docs, bench, max_windows=windows, max_hashes=hashes)
    want = Counter(brute.decontaminate(rows, items))
    assert table(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    for r in out.where("n_hit > 0").select("text", "spans", "n_hit").collect():
        assert sum(len(brute.words(r.text[s.start : s.end])) for s in r.spans) == r.n_hit


def test_decontamination_without_benchmark(spark, docs, rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontam.decontaminate(docs, bench)
    assert out.where("contaminated OR n_items > 0").isEmpty() and out.count() == len(rows)


@pytest.mark.parametrize("percent, block, hot, cell, wide", [(85, neardup.BLOCK_BYTES, neardup.HOT_BUCKET, neardup.CELL_ROWS, 1), (85, 4000, neardup.HOT_BUCKET, 3, 0), (60, neardup.BLOCK_BYTES, 4, 3, 1), (60, neardup.BLOCK_BYTES, 4, neardup.CELL_ROWS, 0)])
def test_near_dedup(docs, rows, percent, block, hot, cell, wide, monkeypatch):
    """With small families, hot buckets, small cells, and sets that are joined by a shuffle."""
    monkeypatch.setattr(neardup, "BROADCAST_BYTES", wide * neardup.BROADCAST_BYTES)
    monkeypatch.setattr(neardup, "SALT_PAIRS", 2048 if wide else 5)
    want = brute.near(rows, percent)
    got = neardup.groups(docs, percent, block, hot, cell).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(brute.shingles(t))) for d, t in rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id), r


def test_near_dedup_of_rows_that_share_an_id(spark):
    r = np.random.RandomState(6)
    texts = {c: " ".join(f"{c}{x}" for x in r.randint(0, 10**6, 80)) for c in "ABCDE"}
    near_b = texts["B"] + " tail"
    rows = [(3, texts["A"]), (5, texts["A"]), (5, texts["B"]), (9, texts["B"]), (1, texts["C"]), (7, near_b), (8, texts["D"]), (6, texts["D"]), (6, texts["E"]), (6, "one"), (4, "one"), (2, None), (2, texts["C"])] + [(6, f"{i} words of its own") for i in range(20)]
    want = brute.near(rows)
    assert want[9] == want[7] == want[5] == 3 and want[8] == 4 and want[2] == 1
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter((d, want[d], want[d] == d) for d, _ in rows)


def test_hot_buckets_are_found(spark, monkeypatch):
    """Counts that are merged from tasks and cut to the most frequent still show every key above the share."""
    import pyarrow as pa

    bands = [np.array([i, *range(i * 20, i * 20 + 15)] if i % 3 else range(16), "<u4").tobytes() for i in range(3000)]
    whole = pa.record_batch([pa.array(bands, pa.binary())], names=["bands"])
    found = {}
    for r in (x for b in neardup._heavy([whole.slice(0, 1000), whole.slice(1000)]) for x in b.to_pylist()):
        found[r["key"]] = r["n"]
    keys = Counter(neardup._table_keys(whole.column(0)).ravel().tolist())
    short = sum(keys.values()) // neardup.HEAVY
    assert {k for k, n in keys.items() if n > short} <= set(found) and all(keys[k] - short <= n <= keys[k] for k, n in found.items())
    monkeypatch.setattr(neardup, "HEAVY", 512)
    few = {r["key"]: r["n"] for b in neardup._heavy([whole.slice(0, 1000), whole.slice(1000)]) for r in b.to_pylist()}
    assert {k for k, n in keys.items() if n > 2 * 192_000 // 512} <= set(few) and len(few) <= 512 and all(n <= keys[k] for k, n in few.items())
    monkeypatch.undo()
    df = spark.createDataFrame([(b,) for b in bands], "bands binary").repartition(4)
    assert neardup.hot_buckets(df, 3000, 10**4) == {} and len(neardup.hot_buckets(df, 3000, 800)) == 64
    same = df.select(F.lit(bands[0]).alias("bands"))
    assert len(neardup.hot_buckets(same, 3000, 500)) == 64


def test_near_dedup_keeps_all_columns(docs, rows):
    want = brute.near(rows)
    out = neardup.near_dedup(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(d for d, _ in rows if d is None or want[d] == d)


def test_stars_and_pairs_of_a_split_bucket():
    import pyarrow as pa

    n = np.array([10, 10, 11, 13, 14, 40, 41, 7, 9, 9], np.int64)
    key, v = np.array([1] * 7 + [2] * 2 + [3], np.int64), np.arange(10, dtype=np.int64)
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(10, -1)), pa.array(v), pa.array(n)], names=["key", "salt", "v", "n"])
    one = [r for b in neardup._stars(85)([whole]) for r in b.to_pylist()]
    for cut in range(1, 10):
        parts = [r for b in neardup._stars(85)([whole.slice(0, cut), whole.slice(cut)]) for r in b.to_pylist()]
        assert sorted(map(str, parts)) == sorted(map(str, one))
    assert {(r["u"], r["v"]) for r in one} == {(0, 0), (0, 1), (0, 2), (3, 3), (3, 4), (5, 5), (5, 6), (7, 7), (8, 8)}


def test_components(spark):
    r = np.random.RandomState(2)
    edges = [(int(a), int(b)) for a, b in r.randint(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)]
    want = brute.closure({x for e in edges for x in e}, edges)
    df = spark.createDataFrame([*edges, (None, 5), (7, None)], "a long, b long")
    for hot, local in ((runtime.HOT_ROWS, 0), (3, 0), (3, 1 << 19)):
        got = {x.id: x.component for x in runtime.components(df, hot_rows=hot, local_edges=local).collect()}
        loops = {a for a, b in edges if a == b}
        assert all(got.get(i, i) == c for i, c in want.items()) and set(got) | loops >= set(want)
    assert runtime.components(df.limit(0)).isEmpty()


def vectors():
    r = np.random.RandomState(4)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((150, 16)))]
    centre = r.standard_normal(16)
    rows += [(200 + i, (centre + 0.05 * r.standard_normal(16)).tolist()) for i in range(60)]
    rows += [(300 + i, (rows[i][1] if i % 2 else [3.0 * x for x in rows[i][1]])) for i in range(20)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [None] + [1.0] * 15), (404, [float("nan")] * 16), (405, [float("inf")] * 16), (None, rows[0][1]), (406, rows[0][1][:8]), (407, rows[0][1][:8]), (3, rows[3][1]), (408, [1.0]), (409, [2.0]), (410, [1e200] * 16)]
    return rows


@pytest.mark.parametrize("hot, most", [(embdup.HOT, embdup.HOT_MAP), (8, embdup.HOT_MAP), (8, 0)])
def test_embedding_dedup(spark, hot, most):
    rows = vectors()
    links = brute.vector_links(rows)
    n = Counter(i for e in links for i in e)
    comp = brute.closure({d for d, _ in rows if d is not None}, [(rows[i][0], rows[j][0]) for i, j in links])
    df = spark.createDataFrame([(d, v, 1, "x", "y") for d, v in rows], "vec_id long, embedding array<double>, label int, digest string, rep string").repartition(3)
    got = embdup.groups(df, hot=hot, hot_map=most).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter((d, n[i], comp.get(d)) for i, (d, _) in enumerate(rows))
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_embedding_recall_at_the_threshold():
    """Pairs of just the least cosine, 64 dimensions, for the numbers of directions of a thousand to a hundred million vectors."""
    r = np.random.RandomState(1)
    x = r.standard_normal((800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal(x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y
    for n in (1e3, 1e5, 1e7, 1e8):
        k = embdup.directions(int(n))
        a, b = embdup.decode(x, k), embdup.decode(y, k)
        found = np.mean([bool(set(p) & set(q)) for p, q in zip(a, b)])
        assert found >= (0.99 if n < 1e8 else 0.98), (n, found)
        assert embdup.FEWEST * embdup.CODES <= np.mean([len(p) for p in a]) <= 16


def test_embedding_links_of_a_whole_table(spark):
    """Pairs at and around the least cosine, among vectors of their own, exact copies and a shared id."""
    r = np.random.RandomState(12)
    x = r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal(x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = np.linspace(0.93, 0.97, 3000)[:, None]
    v = np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])
    rows = [(i, e.tolist()) for i, e in enumerate(v)] + [(7000, v[5].tolist()), (7000, v[9].tolist())]
    whole = np.array([e for _, e in rows])
    unit = whole / np.linalg.norm(whole, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    got = {}
    for row in embdup.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect():
        got.setdefault(row.vec_id, []).append(row)
    n = np.array([got[i][0].n_links for i in range(6000)])
    assert (n <= want[:6000]).all() and n.sum() >= 0.99 * want[:6000].sum() and want.sum() > 3000
    assert got[5][0].component_id == got[9][0].component_id == 5 and {x.component_id for x in got[7000]} == {5}


def test_secrets(docs, rows):
    kinds = ("assign", "access", "hex")
    show = lambda s: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in s)
    want = Counter((d, *(sum(x[1] == k for x in brute.secrets(t)) for k in range(3)), hashlib.sha256(show(brute.secrets(t)).encode()).hexdigest()) for d, t in rows)
    out = secrets.scan(docs)
    assert table(out, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    texts = {d: t for d, t in rows}
    for r in out.where("doc_id IS NOT NULL").collect():
        assert set(filter(None, show(brute.secrets(texts[r.doc_id])).split(","))) <= set(r.spans.split(","))


def test_secret_ownership(spark):
    live, shared = "ghp_" + "Ab1" * 10, "ghp_" + "Cd2" * 10
    rows = [(1, f"é {live}", "a"), (2, f"{live} again", "a"), (3, shared, "a"), (4, shared, "b"), (5, shared, None), (5, shared, None), (6, f"password={'q' * 8}", None), (7, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert got[1].spans == "vendor:2:36" and got[1].n_live == 1 and [tuple(x) for x in got[1].live] == [("vendor:2:36", 2, 1, 1)]
    assert got[3].spans == "" and got[3].n_example == 1 and got[3].n_live == 0
    assert got[6].spans == "assign:0:17" and got[6].n_live == 1
    two = {r.doc_id: r for r in secrets.scan(df, live_owners=3).collect()}
    assert two[4].spans == "vendor:0:34"


def test_secret_ownership_over_a_corpus(spark):
    """Verdicts by plain counts: copies over owners, over many repositories of one owner, repeated rows, nulls, a hot live value."""
    r = np.random.RandomState(8)
    values = ["sk_live_" + "".join(r.choice(list("abcXYZ0189"), 24)) for _ in range(12)]
    rows = []
    for i in range(400):
        repo = None if i % 31 == 0 else f"r{i % 5 if i % 4 else i % 17}"
        owner = None if i % 37 == 0 else f"o{i % 4}"
        text = " é ".join(values[k] for k in r.randint(0, 12, r.randint(0, 3))) if i % 3 else f"mine {values[0][:-3]}{i % 40:03d} and hot sk_live_{'q1' * 12}"
        rows.append((i // 2, text, repo, owner if i % 3 else "o9"))
    docs, repos, owners = {}, {}, {}
    for k, (_, t, repo, owner) in enumerate(rows):
        for v in {t[s:e] for s, kind, _, s, e in ((a, b, c, d, f) for a, b, c, d, f in secrets.find(t.encode())) if kind == 3} if t.isascii() else {t.encode()[d:f].decode() for a, b, c, d, f in secrets.find(t.encode()) if b == 3}:
            docs.setdefault(v, set()).add(k)
            repos.setdefault(v, set()).add(repo)
            owners.setdefault(v, set()).add(owner)
    df = spark.createDataFrame(rows, "doc_id long, text string, Repo string, Owner string").repartition(3)
    for most_owners, most_repos in ((1, 2), (1, 100), (2, 4), (100, 3)):
        want = Counter()
        for _, t, _, _ in rows:
            found = [(len(t.encode()[:a].decode()), t.encode()[d:f].decode()) for a, b, _, d, f in secrets.find(t.encode())]
            live = [(f"vendor:{a}:{a + len(v)}", len(docs[v]), len(repos[v]), len(owners[v])) for a, v in found if len(owners[v]) <= most_owners and len(repos[v]) <= most_repos]
            want[(t, str(live), len(found) - len(live))] += 1
        got = secrets.scan(df.withColumn("copy", F.col("text")), F.col("Repo"), F.col("Owner"), most_owners, most_repos).collect()
        assert Counter((x.copy, str([tuple(y) for y in x.live]), x.n_example) for x in got) == want
        assert sum(x.n_live for x in got) and sum(x.n_example for x in got)


def test_secrets_take_time_in_proportion():
    import time

    import pyarrow as pa

    r = np.random.RandomState(3)
    tokens = ["".join(r.choice(list("xyzXYZ0189"), 40)) + "aA1" for _ in range(20_000)]
    text = "é " + " ".join(x + " " + "0af1" * 8 for x in tokens)
    began = time.perf_counter()
    (row,) = secrets.candidates(pa.array([text])).to_pylist()
    assert len(row) == 40_000 and time.perf_counter() - began < 5
    assert all(text[x["start"] : x["end"]] in (tokens[i // 2], "0af1" * 8) for i, x in enumerate(sorted(row, key=lambda x: x["start"])))


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    for out in (licenses.scan(empty), linededup.line_dedup(empty), decontam.decontaminate(empty, bench), neardup.groups(empty), neardup.near_dedup(empty), packing.pack(empty, *queries.vocabulary()), secrets.scan(empty), toxicity.score(empty, toxicity.train([], [])), quality.score(empty, quality.train([], []))):
        assert out.collect() == []
    assert embdup.groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


CLASHING = ["Text", "DOC_ID", "N_Words", "N_Hit", "Score", "SCORE", "Live", "N_lines", "Labels", "Kept", "__row", "row", "ROW", "Source", "x0_", "same", "same"]


def test_clashing_names(spark):
    """Names that differ from inner ones, results or needed columns in case alone, or not at all: values stay, results replace their namesakes."""
    rows = [(1, "the mit license", "a"), (2, "password=abcdef12 one two three", "b"), (2, "password=abcdef12 one two three", "b"), (3, None, None)]
    docs = spark.createDataFrame([(*r, *[f"v{i}" for i in range(len(CLASHING))]) for r in rows], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASHING]]))
    bench = spark.createDataFrame([(1, "one two three", "x")], "item_id long, text string, TEXT string")
    labels = spark.createDataFrame([(i, i % 2, i % 2, 5) for i in range(1, 4)], "doc_id long, quality int, toxic int, Doc_Id int")
    few = docs.toDF("doc_id", "text", "source", *[f"c{i}" for i in range(len(CLASHING))]).select("doc_id", "text", "source")
    for f, made in (
        (lambda d: licenses.scan(d), licenses.RESULT.names),
        (lambda d: decontam.decontaminate(d, bench), decontam.RESULT.names),
        (lambda d: decontam.decontaminate(d, bench, max_windows=0 + 1), decontam.RESULT.names),
        (lambda d: linededup.line_dedup(d, 2), ["n_lines", "n_dropped"]),
        (lambda d: linededup.line_dedup(d, 2, keep="first", max_broadcast=0), ["n_lines", "n_dropped"]),
        (lambda d: secrets.scan(d), [x.name for x in secrets._RESULT]),
        (lambda d: neardup.near_dedup(d), []),
        (lambda d: toxicity.score(d, toxicity.fit(d, labels), d.columns), ["score"]),
        (lambda d: quality.score(d, quality.fit(d, labels), d.columns), ["score"]),
    ):
        out, plainly = f(docs), f(few)
        low = {m.lower() for m in made}
        kept = [c for c in docs.columns if c.lower() not in low]
        at = [i for i, c in enumerate(out.columns) if c in kept and c not in plainly.columns]
        own = [next(i for i, x in enumerate(out.columns) if x == c) for c in plainly.columns]
        assert [out.columns[i] for i in at] == [c for c in kept[3:]]
        rows_out = out.collect()
        assert all(r[i] == f"v{CLASHING.index(out.columns[i])}" for r in rows_out for i in at if out.columns[i] != "same")
        assert sorted(str([r[i] for i in own]) for r in rows_out) == sorted(str(list(r)) for r in plainly.collect())
    assert neardup.groups(docs).count() == 4
    assert sum(r.length for r in packing.pack(docs, *queries.vocabulary()).collect()) == sum(r.length for r in packing.pack(few, *queries.vocabulary()).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_feistel_is_a_bijection(n):
    a = trainorder.slot_of(np.arange(n), n)
    assert sorted(a.tolist()) == list(range(n))
    assert (trainorder.number_of(a, n) == np.arange(n)).all()
    assert n < 64 or (a != trainorder.slot_of(np.arange(n), n, 1)).any()


def test_training_order(spark, docs, rows, tmp_path):
    path, vocabulary = f"file://{tmp_path}/shards", queries.vocabulary()
    got = trainorder.materialise(docs, path, *vocabulary, size=256, rows=50).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n)) and len({r.sequence_id for r in got}) == n
    assert all((r.shard, r.position) == divmod(r.slot, 50) for r in got)
    want = Counter()
    pieces = defaultdict(list)
    for p in packing.pack(docs, *vocabulary, size=256, keep_ids=True).collect():
        pieces[p.sequence_id].append((p.offset, bytes(p.ids)))
    want = Counter(b"".join(x for _, x in sorted(v)) for v in pieces.values())
    files = [x.astype("<u4") for x in trainorder.read(path)]
    assert sum(map(len, files)) == sum(len(k) * v for k, v in want.items()) // 4
    assert sorted(map(len, files)) == sorted(len(k) // 4 for k in want.elements())
    by = {r.slot: r for r in got}
    assert all(zlib.crc32(x.tobytes()) == by[i].ids_crc32 and len(x) == by[i].n_tokens for i, x in enumerate(files))
    trainorder.materialise(docs, path + "4", *vocabulary, size=256, rows=20, tasks=1).count()  # several shards a task
    assert [x.tolist() for x in trainorder.read(path + "4")] == [x.tolist() for x in files] and n // 20 > 4
    again = list(trainorder.read(path, n - 70, 60))
    assert [x.tolist() for x in again] == [x.tolist() for x in files[n - 70 : n - 10]]
    with pytest.raises(Exception, match="doesn't fit"):
        trainorder.materialise(docs, path + "2", *vocabulary, type="u1").count()
    assert trainorder.materialise(docs.limit(0), path + "3", *vocabulary).count() == 0 and list(trainorder.read(path + "3")) == []
