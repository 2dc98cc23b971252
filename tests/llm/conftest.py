import random

import pytest
from pyspark.sql import types as T

random.seed(5)
_SYL = "the an or ing ed er th re on ti és ñá ou la ch ver".split()


def word(r):
    return "".join(r.choice(_SYL) for _ in range(r.randint(1, 4)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n)) + "."


INSULTS = "idiot moron loser scum clown".split()


def _documents():
    r = random.Random(11)
    item = prose(r, 30)
    passage = prose(r, 60)
    base = prose(r, 120)
    rows = [
        (1, None), (2, ""), (3, "\n"), (4, " \t\n\x0b"), (5, "one"), (6, "Two words"), (7, "ONE"), (8, "one two three"),
        (9, base), (10, base), (10, base), (11, base.replace("the", "tha", 1)), (12, base.upper()), (13, base + " tail of it"), (None, base), (None, None),
        (20, "Licensed under the Apache License, Version 2.0.\n" + prose(r, 50)),
        (21, "licenced under the Apache Licens version 2.0 " + prose(r, 10)),
        (22, "GNU  General--Public\nLicense and MIT license cc by"),
        (23, "Permision is hereby granted, free of charge, to any persn obtaining a copy"),
        (30, 'password = "hunter2hunter2" é token:abc123 AKIA' + "A" * 16 + " " + "0a" * 16),
        (31, "ñ secret=abc " + "f" * 23 + " AKIASHORT api_key='" + "9" * 40 + "'"),
        (32, "ghp_" + "Ab1" * 10 + " Zx9" + "Qw8" * 12), (33, "x Zx9" + "Qw8" * 12), (34, "<|endoftext|> a\x1cb ࡰ \U0001F600"),
        (40, item), (41, prose(r, 30) + " " + " ".join(item.split()[3:18]) + " " + prose(r, 40)), (42, prose(r, 2000) + " " + " ".join(item.split()[5:19])),
        (50, prose(r, 60_000)),
    ]
    rows += [(100 + i, prose(r, 20) + "\n  Shared LINE here \n" + prose(r, 5) + ("\nnine" if i < 9 else "\nten only")) for i in range(12)]
    rows += [(150 + i, passage + " " + prose(r, r.choice((20, 70)))) for i in range(30)]
    for i in range(40):  # near copies, all with different sets
        w = base.split()
        w[r.randrange(len(w))] = f"x{i}"
        rows.append((200 + i, " ".join(w)))
    for i in range(120):
        toxic = i % 3 == 0
        w = [word(r) for _ in range(60)]
        if toxic:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(INSULTS)
        if i % 4 == 1:
            w = [x + r.choice(("***", "$$$", "%%%")) for x in w]
        rows.append((1000 + i, " ".join(w)))
    return rows, item


@pytest.fixture(scope="session")
def rows():
    return _documents()[0]


@pytest.fixture(scope="session")
def items():
    item = _documents()[1]
    return [(1, item), (2, "two words"), (3, None), (None, "one two three"), (4, ""), (2, "one two three"), (10, item.upper())]


EXTRA = ["score", "n_lines", "n_words", "kept", "labels", "spans", "n_hit", "component_id", "n", "digest", "rep", "u", "v", "salt", "window", "__row", "row", "__runs", "items", "__cand", "cand", "repo", "owner", "__owner", "gone", "h", "x0_"]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with nulls, empty and long texts, repeated rows, and columns that clash with results and inner names."""
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField(n, T.StringType()) for n in EXTRA])
    values = [(d, t, None if i % 5 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), *["x"] * len(EXTRA)) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(values, schema).repartition(3)


@pytest.fixture(scope="session")
def folder(spark, docs, rows, items, tmp_path_factory):
    """A data folder of the fixture tables."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1000 + i, int(i % 4 != 1), int(i % 3 == 0)) for i in range(120)] + [(9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
