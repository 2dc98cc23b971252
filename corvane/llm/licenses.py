"""License scans: exact phrases, and fuzzy search for short notices.

*Base*: places where a phrase's words stand consecutively (A-Z lower-cased; words are
runs of ASCII letters and digits and of all non-ASCII characters).

*Method*: each notice of a catalogue may occur with up to ``k`` errors (inserted, deleted
or replaced characters of its normalised form). By the pigeonhole principle a notice cut
into k + 1 pieces has a piece without error in every such occurrence, so all pieces are
searched exactly (one alternation over the normalised text); around each find a window
that any occurrence must lie in is checked by the regex library's bounded-error
matching (``(?be)(?:notice){e<=k}``), which reports the span and the number of edits.
That gives a window's best find alone, so what it leaves free to its left and right is
searched again. Overlapping finds of a notice keep the one with fewest edits, then the leftmost.

Whole texts are scanned, a chunk of rows at a time. Defined results: a null or empty
text has no words, no labels and score 0; repeated rows are scanned each; columns of docs
named like a result (in any case) are replaced, all others kept.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import textvec as tv
from .decontam import normalised
from .runtime import plain

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: notice, label, allowed errors; each piece of a notice cut into errors + 1 must be a few characters long
NOTICES = (
    ("licensed under the apache license version 2 0", "apache", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("released under the mit license", "mit", 3),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("licensed under cc by", "cc-by", 2),
    ("all rights reserved", "proprietary", 2),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
    ("spdx license identifier", "spdx", 2),
)

_FOUND = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])
RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("notices", T.ArrayType(_FOUND))]
)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice cut into k + 1 pieces of about the same length, with their offsets."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES, base=BASE):
        import ahocorasick
        import regex

        self.auto = ahocorasick.Automaton()
        for phrase, label in base.items():
            self._add(" " + phrase + " ", ("base", phrase.count(" ") + 1, label))
        self.notices = [(n.encode().decode("latin-1"), label, k, regex.compile(rf"(?be)(?:{regex.escape(n.encode().decode('latin-1'), literal_spaces=True)}){{e<={k}}}")) for n, label, k in notices]
        for x, (n, _, k, _) in enumerate(self.notices):
            for at, piece in pieces(n, k):
                self._add(piece, ("seed", x, at))
        self.auto.make_automaton()

    def _add(self, key: str, what: tuple) -> None:
        self.auto.add_word(key, [*self.auto.get(key, []), what])

    def rows(self, buf: np.ndarray, off: np.ndarray):
        """For each row: words; (word, label) of base finds; (label, start, end, edits) of notices, bytes in the row's original text."""
        text, begin, e, wp = normalised(buf, off)
        s = tv.words(buf, off)[0]
        base: dict[int, list] = {}
        around: dict[tuple[int, int], list] = {}
        for x, whats in self.auto.iter(text):
            for kind, n, label in whats:
                if kind == "base":
                    w = int(np.searchsorted(begin, x)) - n
                    r = int(np.searchsorted(wp, w, "right")) - 1
                    base.setdefault(r, []).append((w - int(wp[r]), label))
                else:
                    notice, _, k, _ = self.notices[n]
                    piece_at = label
                    w = int(np.searchsorted(begin, x, "right")) - 1
                    if w < 0:
                        continue
                    r = int(np.searchsorted(wp, w, "right")) - 1
                    start = x - piece_at - len(notice) - 2 * k  # wide enough for any occurrence that holds this piece in its place
                    around.setdefault((r, n), []).append((start, x + len(notice) + 2 * k))
        found: dict[int, list] = {}
        for (r, n), spans in around.items():
            notice, label, k, rx = self.notices[n]
            lo, hi = int(begin[wp[r]]) - 1, int(begin[wp[r + 1] - 1] + (e[wp[r + 1] - 1] - s[wp[r + 1] - 1])) + 1
            for i, j, edits in _finds(rx, text, _merged(spans, lo, hi, 8 * (len(notice) + 2 * k))):
                while i < j and text[i] == " ":
                    i += 1
                while j > i and text[j - 1] == " ":
                    j -= 1
                wi, wj = int(np.searchsorted(begin, i, "right")) - 1, int(np.searchsorted(begin, j - 1, "right")) - 1
                if wi < 0 or wj < wi:
                    continue
                start, end = int(s[wi] + (i - begin[wi])), min(int(e[wj]), int(s[wj] + (j - begin[wj])))
                found.setdefault(r, []).append((label, start - int(off[r]), end - int(off[r]), edits, len(notice)))
        return wp, base, found


def _merged(spans: list, lo: int, hi: int, most: int) -> list:
    """Windows that overlap become one of up to ``most`` characters; past that the next begins at its own start, so each span lies whole in a window."""
    out: list[list[int]] = []
    for a, b in sorted((max(lo, a), min(hi, b)) for a, b in spans):
        if out and b <= out[-1][1]:
            continue
        if out and a <= out[-1][1] and b - out[-1][0] <= most:
            out[-1][1] = b
        elif b > a:
            out.append([a, b])
    return out


def _finds(rx, text: str, windows: list) -> list:
    """(start, end, edits) of finds that don't overlap: always the best of all that is left, then the leftmost, in order of place.

    Windows are bounded, and a find has only the few that overlap it searched again, so the cost grows with the text.
    """
    heap: list = []

    def search(a, b):
        m = rx.search(text, a, b) if b > a else None
        if m and m.end() > m.start():
            heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

    for a, b in windows:
        search(a, b)
    taken: list[tuple[int, int, int]] = []
    while heap:
        edits, i, j, a, b = heapq.heappop(heap)
        x = bisect.bisect_right(taken, (i, j, edits))
        cut = next((t for t in taken[max(0, x - 1) : x + 1] if t[0] < j and i < t[1]), None)
        if cut is None:
            taken.insert(x, (i, j, edits))
            cut = taken[x]
        search(a, min(b, cut[0]))
        search(max(a, cut[1]), b)
    return taken


def scan(docs: DataFrame, notices=NOTICES, base=BASE) -> DataFrame:
    """All columns of docs and RESULT's. score is 1 for a base find, else the best notice's share of unchanged characters, else 0; notices' spans are code points of the original text."""
    docs, back = plain(docs, ["text"], RESULT.names)
    schema, text = T.StructType(docs.schema.fields + RESULT.fields), docs.columns.index("text")
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))]

    def run(batches):
        scanner = Scanner(notices, base)
        for batch in batches:
            rows = []
            for lo, hi, buf, off in tv.chunks(batch.column(text)):
                wp, bases, found = scanner.rows(buf, off)
                for r in range(hi - lo):
                    own, near = sorted(bases.get(r, ())), found.get(r, ())
                    spans, score = [], float(bool(own))
                    if near:
                        points = np.concatenate([[0], np.cumsum((buf[off[r] : off[r + 1]] & 0xC0) != 0x80)])
                        spans = [{"label": x[0], "start": int(points[x[1]]), "end": int(points[x[2]]), "edits": x[3]} for x in sorted(near, key=lambda x: (x[1], x[2], x[0]))]
                        score = max(score, max(1 - x[3] / x[4] for x in near))
                    labels = {x[1] for x in own}
                    rows.append((int(wp[r + 1] - wp[r]), len(own), own[0][0] if own else None, own[-1][0] if own else None, ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in near})), score, spans))
            cols = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(list(c), k) for c, k in zip(cols, kinds)], names=schema.names)

    return back(docs.mapInArrow(run, schema))
