"""The session's shared folder: tables that cut lineage, tables that are built once, and sinks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_built: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
        atexit.register(drop, spark, _own[app])
    return _own[app]


def path_of(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder; errors are left alone, as at the interpreter's end."""
    try:
        fs, p = path_of(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may have ended
        pass


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors, never computes df twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, *paths: str) -> tuple:
    """What changes when one of the tables does: place, size and time of each."""
    out = []
    for path in paths:
        fs, p = path_of(spark, path)
        status, size = fs.getFileStatus(p), fs.getContentSummary(p).getLength()
        out.append((path, size, status.getModificationTime()))
    return tuple(out)


def once(spark: SparkSession, name: str, sources: list[str], build: Callable[[str], None], anew: bool = False) -> str:
    """The folder that ``build`` fills. It is filled once for a session and the state of its source tables; a source that changes, a folder that was removed, or ``anew`` has it built again."""
    key = (spark.sparkContext.applicationId, name, stamp(spark, *sources))
    if anew or key not in _built or not exists(spark, f"{_built[key]}/done"):
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build(path)
        fs, p = path_of(spark, f"{path}/done")
        fs.mkdirs(p)
        _built[key] = path
    return _built[key]


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a stored table; each write is committed as a whole. Names are matched, other columns are an error."""
    spark = df.sparkSession
    if exists(spark, path):
        have = spark.read.parquet(path).schema
        if set(df.columns) != set(have.names):
            raise ValueError("columns differ")
        df = spark.createDataFrame([], have).unionByName(df)
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Puts a table in place of the one at path, of which df may be made: written beside it, then swapped by renaming."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, p = path_of(spark, path)
    if fs.exists(p) and not fs.rename(p, path_of(spark, old)[1]):
        raise OSError(f"can't move {path}")
    if not fs.rename(path_of(spark, new)[1], p):
        raise OSError(f"can't move {new}")
    drop(spark, old)
