"""What the operators of this subpackage share: reading tables, written intermediate tables, joins with hot keys."""

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the word-based operators split at: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local session, whose executors are the
    driver, may do without; elsewhere a machine's own folder would lose data, so that is an error."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@lru_cache
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix=f'lodeworks-{application}-')}"


#: The list of the innermost `scratch`; without one, tables stay until the program ends.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
_UNTIL_EXIT: list[str] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths of the tables that `written` makes meanwhile. `delete` them once what was made of them has
    been written; until then they are read."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield paths
    finally:
        _SCRATCH.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes these tables and empties the list; tables of other lists are left alone."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def until_exit(paths: Iterable[str]) -> None:
    """These tables are deleted when the program ends."""
    _UNTIL_EXIT.extend(paths)


@atexit.register
def _at_exit() -> None:
    if SparkContext._active_spark_context is not None and _UNTIL_EXIT:
        delete(SparkSession.builder.getOrCreate(), _UNTIL_EXIT)


#: Bytes of a row group of the tables that `written` makes: what a task holds back of the texts that it writes.
ROW_GROUP = 32 << 20
#: Rows of an Arrow batch that goes to a Python task. Whole texts are long, and a task holds a batch several times over.
BATCH_ROWS = 500


@contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches have so many rows at most meanwhile; the session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, keep: bool = False, rows: int = BATCH_ROWS) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation.
    keep: the table is no part of a `scratch`. rows: of an Arrow batch, more where rows are short."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with short_batches(spark, rows):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    own = _SCRATCH.get()
    (_UNTIL_EXIT if keep or own is None else own).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks among which `salted` deals out the rows of one key.
SALTS = 8


def salted(rows: DataFrame, lookup: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined by key with a table that has one row a key. Rows of one key are dealt out by a hash of `by` among
    SALTS tasks, to each of which the key's row is copied: a hot key is no single task's burden."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def ordered_parts(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df dealt out by ranges of an order and written: part is the range's number, nth a row's place in the range.
    With one running sum over the parts, that gives places in the whole without a task that sees all rows."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id()
    return written(dealt.select("*", F.spark_partition_id().alias("part"), inside.bitwiseAND((1 << 33) - 1).alias("nth")), name)


def words(text: Column) -> Column:
    """The words of a text, an array; nothing for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once a row however often use names it."""
    return F.transform(F.array(value), use)[0]


def carried(columns: tuple[str, ...]) -> list[Column]:
    """Input columns under names of their own, so that they can't clash with an operator's."""
    return [F.col(c).alias(f"carried_{c}") for c in columns]
