"""Identifier tokens as column expressions: scan, normalise, sub-word split, emission."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

IDENTIFIER = "[A-Za-z0-9_]+"
MAX_PARTS = 16
MAX_CHARS = 256
#: identifiers that have no parts: no capital after a digit or a small letter
PLAIN = "^(?:[A-Z]?[a-z0-9]*|[A-Z]*[0-9]*)$"

#: tokens (doc_id, pos, term) from a CTE ``src`` with doc_id and content
TOKENS_SQL = r"""ids AS (
  SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tok FROM (SELECT doc_id, regexp_extract_all(content, '[A-Za-z0-9_]+') AS t FROM src)
), split AS (
  SELECT doc_id, pos, left(lower(regexp_replace(tok, '[^A-Za-z0-9]', '', 'g')), 256) AS whole,
    list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(tok, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '_+', ' ', 'g'), ' '),
      lambda x: x <> '')[1:16], lambda x: left(lower(x), 256)) AS parts FROM ids
), tokens AS (
  SELECT doc_id, pos, term FROM (SELECT doc_id, pos, unnest(list_concat([whole], list_filter(parts, lambda p: p <> whole))) AS term FROM split WHERE whole <> '')
)"""


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def normalize(token: Column) -> Column:
    """ASCII letters and digits, lower case, at most 256."""
    return F.substring(F.lower(F.regexp_replace(token, "[^A-Za-z0-9]", "")), 1, MAX_CHARS)


def split_identifier(token: Column) -> Column:
    """Parts at camelCase borders, the end of acronyms and underscores; at most 16, case kept."""
    t = F.regexp_replace(token, "([a-z0-9])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.slice(F.filter(F.split(F.regexp_replace(t, "_+", " "), " "), lambda x: x != ""), 1, MAX_PARTS)


def emissions(token: Column) -> Column:
    """What one identifier puts into the index: itself normalised, and its parts unless equal to it. Plain words skip the split."""
    whole = normalize(token)
    parts = F.transform(split_identifier(token), lambda x: F.substring(F.lower(x), 1, MAX_CHARS))
    split = F.when(whole != "", F.concat(F.array(whole), F.filter(parts, lambda p: p != whole))).otherwise(F.array().cast("array<string>"))
    return F.when(token.rlike(PLAIN) & (F.length(token) <= MAX_CHARS), F.array(F.lower(token))).otherwise(split)


def emitted(token: str) -> list[str]:
    """emissions() of one identifier."""
    whole = token.replace("_", "").lower()[:MAX_CHARS]
    t = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", token))
    parts = [x.lower()[:MAX_CHARS] for x in t.replace("_", " ").split(" ") if x]
    return [whole, *(p for p in parts[:MAX_PARTS] if p != whole)] if whole else []


def query_terms(query: str) -> dict[str, int]:
    """Terms of a query with how often each occurs; unlike in texts, ``_`` separates."""
    out: dict[str, int] = {}
    for t in re.findall("[A-Za-z0-9]+", query):
        out[t.lower()[:MAX_CHARS]] = out.get(t.lower()[:MAX_CHARS], 0) + 1
    return out


def is_identifier(query: Column) -> Column:
    """Whether a query is one identifier with a letter in it."""
    return F.trim(F.regexp_replace(query, r"^[ \t\n\r]+|[ \t\n\r]+$", "")).rlike("^[A-Za-z0-9_]*[A-Za-z][A-Za-z0-9_]*$")
