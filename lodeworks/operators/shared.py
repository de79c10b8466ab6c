"""Tables that end a lineage, and joins whose small side is of a checked size."""

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few short columns is broadcast (some MB).
BROADCAST_ROWS = 200_000
#: Tasks among which `salted` deals out the rows of one key.
SALTS = 8


@lru_cache
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix=f'lodeworks-{application}-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


#: The list of the innermost `scratch`; without one, tables stay until the program ends.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
_UNTIL_EXIT: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The folders that are made meanwhile are deleted at its end: what is to stay must have been written by then."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete(spark, paths)


def delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    if SparkContext._active_spark_context is not None and _UNTIL_EXIT:
        delete(SparkSession.builder.getOrCreate(), _UNTIL_EXIT)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes with its `scratch`, or when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = _SCRATCH.get()
    (_UNTIL_EXIT if own is None else own).append(path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which ends its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more than so many rows, which are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted(rows: DataFrame, lookup: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined by key with a table that has one row a key; rows of a hot key are dealt out among SALTS tasks."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
