"""Context for a language model: packing sections into a token budget, and text of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions import nl
from corvane.functions.code import complexity, estimate_tokens
from corvane.operators import graph, search


def pack(sections: DataFrame, budget: int, reserved: int = 0, group: str | None = None) -> DataFrame:
    """Sections (priority, pos, title, content) by priority, then position, while the budget lasts; the first that doesn't fit is cut to what is left, four characters a token, and ends it.

    Without ``group`` there is one budget. The greedy scan is a prefix sum. A group is
    the sections of one answer, so its window is small.
    """
    left = max(0, budget - reserved)
    w = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy(F.desc("priority"), "pos")
    cost = sections.withColumn("tokens", estimate_tokens(F.col("content")))
    before = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(left) - F.col("before")
    out = cost.withColumn("before", before).where(room > 0)
    content = F.when(F.col("tokens") > room, F.left("content", (room * 4).cast("int"))).otherwise(F.col("content"))
    keep = [group] if group else []
    return out.select(*keep, "priority", "pos", "title", content.alias("content")).withColumn("tokens", estimate_tokens(F.col("content")))


def markdown(sections: DataFrame, group: str | None = None) -> DataFrame:
    """One text (of each group) of packed sections."""
    part = F.concat(F.lit("## "), "title", F.lit("\n\n"), "content")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "pos", part.alias("part"))))  # what a budget admits
    text = F.array_join(F.transform(rows, lambda x: x["part"]), "\n\n")
    return (sections.groupBy(group) if group else sections.groupBy()).agg(text.alias("markdown"))


def build(question: str, hits: DataFrame, symbols: DataFrame, edges: DataFrame, documents: DataFrame, budget: int, reserved: int = 0, depth: int = 2) -> DataFrame:
    """One row (markdown): what a model should read to answer a question, within a token budget.

    Sections by priority: texts that a search found, (doc_id, path, snippet) in order (9); the calls around the symbol that the question names (7, only if it names one);
    totals and the largest directories (5). Each part comes from its operator and is a few rows at most, but for calls, which
    the neighbours' cap and the depth bound.
    """
    spark = hits.sparkSession
    row = "priority int, pos int, title string, content string"
    found = [(9, i, f"{r.path}", r.snippet) for i, r in enumerate(hits.collect())]  # a search's k best
    named = [r[0] for r in spark.range(1).select(F.explode(nl.symbols(F.lit(question)))).collect()]
    for name in named:
        start = search.lookup(symbols, name).first()
        if start is not None:
            met = graph.trace(edges, start.id, depth, "both")[1]
            name_of = lambda end: symbols.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
            src, dst = (F.when(F.col("direction") == "outbound", x).otherwise(y) for x, y in (("a", "b"), ("b", "a")) for x, y in ((F.col(x), F.col(y)),))
            lines = met.select(src.alias("s"), dst.alias("d")).distinct().join(name_of("s"), "s").join(name_of("d"), "d")
            text = lines.agg(F.array_join(F.array_sort(F.collect_list(F.concat("s_name", F.lit(" -> "), "d_name"))), "\n").alias("t")).first().t
            found.append((7, len(found), f"Calls around {name}", text))
            break
    totals, largest = graph.architecture(documents, symbols, edges).first(), graph.modules(documents, symbols, 5).collect()
    about = "\n".join([f"{totals.files} files, {totals.symbols} symbols, {totals.edges} edges", *(f"{m.module}: {m.files} files, {m.symbols} symbols" for m in largest)])
    found.append((5, len(found), "Architecture", about))
    return markdown(pack(spark.createDataFrame(found, row), budget, reserved))


def summarize(symbols: DataFrame) -> DataFrame:
    """Summaries of (id, name, kind, code): signature, purpose (the first comment line), key operations (called names in order of appearance), dependencies, complexity."""
    lines = F.split("code", "\n", -1)
    signature = F.trim(F.regexp_replace(F.coalesce(F.get(F.filter(lines, lambda x: F.trim(x) != ""), F.lit(0)), F.lit("")), r"\s*\{?\s*$", ""))
    purpose = F.trim(F.regexp_replace(F.get(F.filter(lines, lambda x: F.ltrim(x).rlike("^(///|//|#|\\*)")), F.lit(0)), r"^\s*(///?|#|\*)+", ""))
    calls = F.array_distinct(F.regexp_extract_all("code", F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\s*\("), F.lit(1)))
    needs = F.array_distinct(F.concat(F.regexp_extract_all("code", F.lit(r'@import\("([^"]+)"\)'), F.lit(1)), F.regexp_extract_all("code", F.lit(r"(?m)^\s*(?:import|from|use)\s+([A-Za-z_][\w.:]*)"), F.lit(1))))
    operations = F.filter(calls, lambda c: ~c.isin("if", "for", "while", "switch", "catch", "return", "fn", "def") & (c != F.col("name")))
    return symbols.select("id", "name", "kind", signature.alias("signature"), F.coalesce(purpose, F.lit("")).alias("purpose"), operations.alias("operations"), needs.alias("dependencies"), F.round(complexity(F.col("code")), 6).alias("complexity"))
