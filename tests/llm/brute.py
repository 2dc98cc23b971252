"""Plain Python versions of the operators, one row at a time."""

import hashlib
import re

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return ALNUM.findall((text or "").translate(LOW))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def base_licenses(text):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    w, hits = words(text), []
    for p, label in phrases.items():
        k = p.split()
        hits += [(i, label) for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
    hits.sort()
    return len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


def edit_distance_anywhere(pattern, text):
    """The least number of edits that turn the pattern into some part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def key(line):
    return line.strip(SPACE).translate(LOW)


def line_dedup(rows, least=10, keep="none"):
    """rows of (doc_id, text) to (doc_id, n_lines, n_dropped, text)."""
    seen, first = {}, {}
    for d, t in rows:
        lines = (t or "").split("\n")
        for k in {key(x) for x in lines}:
            seen[k] = seen.get(k, 0) + 1
        for i, x in enumerate(lines):
            if d is not None and (key(x) not in first or (d, i) < first[key(x)]):
                first[key(x)] = (d, i)
    bad = {k for k, n in seen.items() if n >= least and k}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for i, x in enumerate(lines) if key(x) not in bad or keep == "first" and first.get(key(x)) == (d, i)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def decontaminate(rows, items, size=13):
    """rows of (doc_id, text), items of (item_id, text) to (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text):
    w = SOLID.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def closure(ids, links):
    """The least id reachable, of each id."""
    to = {i: i for i in ids}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near(rows, percent=85):
    """rows of (doc_id, text) to {doc_id: component}."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    links = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    return closure({d for d, _ in sets}, links)


def vector_links(rows, least=0.95):
    """rows of (vec_id, list) to pairs of row numbers that are linked."""
    good = []
    for i, (d, v) in enumerate(rows):
        if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good.append((i, x / np.linalg.norm(x)))
    return [(i, j) for a, (i, x) in enumerate(good) for j, y in good[:a] if len(x) == len(y) and float(x @ y) >= least]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text):
    """Base spans as (start, kind, end)."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)
