"""Questions in natural language: intent, symbols, constraints and tools, as column expressions.

Words are matched as substrings of the lower-cased question, so "how" is in "show" too.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: intents in order of precedence: phrases, one of which must occur, and words that must not
INTENTS = {
    "find_definition": ("declaration of|declare |define |defined|definition of|location of|where are|where is|where's", "explain|how"),
    "find_usage": ("called by|called from|caller of|callers of|dependencies of|dependents of|invoked by|invokes|referenced by|references to|usage of|usages of|used by|used in|what calls|what uses|who calls|who uses", ""),
    "explain": ("describe|explain how|explain the|explain what|how are|how do|how does|how is|tell me about|tell me how|walk through|walkthrough|what are|what do|what does|what is", ""),
    "refactor": ("clean up|extract function|extract method|improve|merge|optimize|refactor|rename|reorganize|restructure|simplify|split", ""),
    "debug": ("broken|bug in|bug:|crash|debug|doesn't work|don't work|error in|error:|exception|failed|failing|fix the|fix this|not working|stack trace|stacktrace|traceback|why does|why is", ""),
    "explore": ("architecture|bird's eye|codebase|entry points|high level|high-level|module structure|overview|project layout|repository|show me how|show me the|structure|what modules", "explain"),
}
TOOLS = {
    "find_definition": "search_code search_graph get_code_snippet",
    "find_usage": "trace_call_path search_graph",
    "explain": "search_code get_code_snippet search_graph get_architecture",
    "refactor": "trace_call_path get_architecture search_graph",
    "debug": "search_code trace_call_path get_code_snippet",
    "explore": "get_architecture detect_communities search_graph",
    "search": "search_code hybrid_search semantic_search",
}
LANGUAGES = "zig|ziglang|python|javascript|js|typescript|ts|rust|go|golang|c |c++|cpp|java|csharp|c#|scala|kotlin|swift|lua|haskell|elixir|clojure|ruby|php|dart".split("|")
STOP = frozenset(
    "about above after all also and any been before below between call called calls could define defined describe does each every explain find for from get have here how into just like list look make more only over search set should show some that the their there they this under very what when where which who why will with would".split()
)


def _any(text: Column, phrases: str) -> Column:
    out = F.lit(False)
    for p in filter(None, phrases.split("|")):
        out = out | F.contains(text, F.lit(p))
    return out


def intent(question: Column) -> Column:
    q = F.lower(question)
    out = F.lit("search")
    for name, (phrases, barred) in reversed(INTENTS.items()):
        hit = _any(q, phrases) & ~_any(q, barred)
        if name == "explain":
            hit = hit | F.contains(q, F.lit("explain")) & ~F.contains(q, F.lit("refactor"))
        out = F.when(hit, name).otherwise(out)
    return out


def intent_sql(q: str) -> str:
    """The same rule in SQL, over an expression that is already lower case."""
    any_of = lambda phrases: " OR ".join(f"contains({q}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases.split("|") if p) or "FALSE"
    out = "CASE"
    for name, (phrases, barred) in INTENTS.items():
        hit = f"(({any_of(phrases)}) AND NOT ({any_of(barred)}))"
        if name == "explain":
            hit = f"({hit} OR (contains({q}, 'explain') AND NOT contains({q}, 'refactor')))"
        out += f" WHEN {hit} THEN '{name}'"
    return out + " ELSE 'search' END"


def tools(intent_column: Column) -> Column:
    out = F.lit(TOOLS["search"])
    for k, v in TOOLS.items():
        out = F.when(intent_column == k, v).otherwise(out)
    return F.split(out, " ")


def symbols(question: Column) -> Column:
    """Words that look like identifiers: two characters or more, a capital or an underscore, no stop word."""
    words = F.regexp_extract_all(question, F.lit("[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & w.rlike("[A-Z_]") & ~F.lower(w).isin(sorted(STOP))))


def language(question: Column) -> Column:
    """The first of LANGUAGES of which "in x" occurs, or null."""
    q, out = F.lower(question), F.lit(None).cast("string")
    for name in reversed(LANGUAGES):
        out = F.when(F.contains(q, F.lit(f"in {name}")), name.strip()).otherwise(out)
    return out


def _extract(q: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(q, pattern, group), F.lit(""))


def _first_kind(q: Column, kinds: list[str], tail: str) -> Column:
    """The tail after the first of the kinds, in their order, that occurs at all."""
    out = F.lit(None).cast("string")
    for k in reversed(kinds):
        out = F.when(F.contains(q, F.lit(k)), _extract(q, f"{k}({tail})")).otherwise(out)
    return out


def constraints(question: Column) -> Column:
    """array<struct<kind, value>>: language, module, file pattern, number of results."""
    q = F.lower(question)
    found = [
        ("language", language(question)),
        ("module", _first_kind(q, ["in module ", "in directory ", "in dir ", "in file "], "[^ ,.]*")),
        ("file_pattern", _extract(q, r"(\*\.[a-z0-9*]*)")),
        ("max_results", _first_kind(q, ["top ", "first "], "[0-9]*")),
    ]
    every = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in found])
    return F.filter(every, lambda x: x["value"].isNotNull())
