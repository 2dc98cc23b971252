"""Directory trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.code import scan


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, mtime) of all files under root; contents aren't read, as the column is pruned."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", "length", F.unix_micros("modificationTime").alias("mtime"))


def contents(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """(path, length, mtime, content, hash, language) of source files that no rule ignores."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.decode("content", "UTF-8")
    return scan(raw, list(rules)).select("path", "length", F.unix_micros("modificationTime").alias("mtime"), text.alias("content"), F.xxhash64("content").alias("hash"), "language")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """(json), an object for each row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
