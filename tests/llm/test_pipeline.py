"""The pipeline, stage by stage, against plain versions on each stage's own input."""

import sys
from pathlib import Path

import brute
import numpy as np
from pyspark.sql import functions as F
from test_operators import check_pieces

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402

from corvane.llm import toxicity  # noqa: E402
from corvane.llm.runtime import source, table  # noqa: E402


def test_stages(spark, folder, items):
    docs = source(spark, folder, "documents")
    columns = docs.columns
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    outs = {}
    for name, f in cp.STAGES:
        before = rows(docs)
        docs = table(f(spark, docs, folder), name)
        outs[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns

    before, out = outs["toxicity"]
    weights, bias = toxicity.fit(source(spark, folder, "documents"), source(spark, folder, "labels"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    kept = []
    for d, t in before:
        w = [x.encode() for x in brute.words(t)]
        f = toxicity.features(w)[0] if w else np.zeros(0, int)
        if bias + (weights[f].astype(float).sum() / len(f) if len(f) else 0) < 0:
            kept.append((d, t))
    assert rows(out) == kept and len(kept) < len(before)

    before, out = outs["line_dedup"]
    assert rows(out) == sorted(((d, t) for d, _, _, t in brute.line_dedup(before)), key=str)
    assert all(r.n_chars == len(r.text) for r in out.collect())

    before, out = outs["near_dedup"]
    comp = brute.near(before)
    assert rows(out) == sorted(((d, t) for d, t in before if d is None or comp[d] == d), key=str)

    before, out = outs["decontamination"]
    found = brute.decontaminate(before, items)
    bad = [x[2] > 0 for x in found]
    assert any(x[0] == 42 and x[2] >= 13 and 20 * x[2] < x[1] for x in found)  # a long text that holds a window goes as well
    assert any(bad) and rows(out) == sorted((x for x, b in zip(before, bad) if not b), key=str)

    before, out = outs["packing"]
    check_pieces(out.collect(), before)

    assert sorted(map(tuple, cp.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect()), key=str) == sorted(map(tuple, out.select("doc_id", "start", "length", "ids_crc32").collect()), key=str) or sum(r.length for r in cp.run(spark, folder).collect()) == sum(r.length for r in out.collect())


def test_stages_keep_columns_of_clashing_names(spark, folder):
    docs = source(spark, folder, "documents").where("doc_id < 50 OR doc_id IS NULL").withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ("score", "n_hit", "n_lines", "kept", "N_Words")})
    for name, f in cp.STAGES[:-1]:
        out = f(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in out.collect() for c in ("score", "n_hit", "n_lines", "kept", "N_Words")), name
