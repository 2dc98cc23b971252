"""Source text as column expressions: token estimates, complexity, languages, ignore rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: languages with their extensions
LANGUAGES = {
    "c": "c h",
    "c_sharp": "cs",
    "cpp": "cc cpp cxx hpp hxx",
    "css": "css",
    "dart": "dart",
    "elixir": "ex exs",
    "go": "go",
    "haskell": "hs",
    "java": "java",
    "javascript": "js jsx mjs",
    "json": "json",
    "lua": "lua",
    "python": "py pyi",
    "rust": "rs",
    "scala": "sc scala",
    "swift": "swift",
    "toml": "toml",
    "tsx": "tsx",
    "typescript": "ts",
    "yaml": "yaml yml",
    "zig": "zig",
}
EXTENSIONS = {e: k for k, v in LANGUAGES.items() for e in v.split()}
SOURCES = "c cpp cs go h hpp java js json jsx kt md php py rb rs toml ts tsx yaml yml zig zon".split()
SKIPPED = (".git", ".zig-cache", "zig-out", "node_modules", "target", ".index")
MAX_FILE = 64 << 20
BRANCH = r"^(?:(?:if|for|while|switch)[ (]|else if|match |catch |else$)"


def estimate_tokens(text: Column) -> Column:
    """A token for four code points, rounded up."""
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def _trimmed_lines(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))
    return F.filter(lines, lambda x: x != "")


def branches(text: Column) -> Column:
    return F.size(F.filter(_trimmed_lines(text), lambda x: x.rlike(BRANCH))).cast("long")


def code_lines(text: Column) -> Column:
    return F.size(_trimmed_lines(text)).cast("long")


def depth(text: Column) -> Column:
    """The deepest brace nesting at a line's end; a closing brace never goes below 0. The fold runs over braces and line ends alone."""
    marks = F.split(F.regexp_replace(F.concat_ws("\n", F.array(F.coalesce(text, F.lit("")), F.lit(""))), "[^{}\n]", ""), "")
    step = lambda s, c: F.struct(
        F.when(c == "{", s["now"] + 1).when(c == "}", F.greatest(F.lit(0), s["now"] - 1)).otherwise(s["now"]).alias("now"),
        F.when(c == "\n", F.greatest(s["top"], s["now"])).otherwise(s["top"]).alias("top"),
    )
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda s: s["top"]).cast("long")


def complexity(text: Column) -> Column:
    return code_lines(text) * 0.1 + branches(text) * 0.5 + depth(text) * 0.3


def language(path: Column) -> Column:
    """By extension; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.element_at(table, F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_source(path: Column, length: Column | None = None) -> Column:
    """An extension of SOURCES, no skipped directory, not too long."""
    ok = path.rlike(r"\.(?:" + "|".join(SOURCES) + r")$") & ~path.rlike(r"(^|/)(" + "|".join(map(re.escape, SKIPPED)) + r")/")
    return ok if length is None else ok & (length <= MAX_FILE)


def glob_regex(glob: str) -> str:
    """A glob of ignore rules as a regular expression for whole paths: ``*`` and ``?`` stay in a directory, ``**`` crosses."""
    anchored, g = "/" in glob.rstrip("/"), glob.strip("/")
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(g[i], re.escape(g[i])), i + 1
    return ("^" if anchored else "(?:^|/)") + out + "(?:/.*)?$"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last matching rule ignores the path; ``!`` negates, ``#`` comments. Rules are few, so they are one expression and need no join."""
    out = F.lit(False)
    for r in rules:
        r = r.strip()
        if r and not r.startswith("#"):
            out = F.when(path.rlike(glob_regex(r.lstrip("!"))), not r.startswith("!")).otherwise(out)
    return out


def scan(files: DataFrame, rules: list[str] = ()) -> DataFrame:
    """Source files of (path, length, ..) that no rule ignores, with their language."""
    return files.where(is_source(F.col("path"), F.col("length")) & ~ignored(F.col("path"), list(rules))).withColumn("language", language(F.col("path")))
