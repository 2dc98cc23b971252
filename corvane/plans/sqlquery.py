"""Guarded SQL over the graph's views: one SELECT, at most 100 rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MOST = 100


def run(spark: SparkSession, query: str, views: dict[str, DataFrame], limit: int = 20) -> DataFrame:
    """The query's rows up to the limit. The statement must begin with SELECT or WITH, as a whole word, and is planned as a subquery, which rules out anything but a query."""
    q = query.strip().rstrip(";").rstrip()
    if not re.match(r"(?is)(select|with)\b", q):
        raise ValueError("only SELECT queries are allowed")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM (\n{q}\n) LIMIT {max(1, min(limit, MOST))}")
