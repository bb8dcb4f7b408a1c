"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a record batch that are worked on together; a longer single row is worked on alone.
BATCH_BYTES = 1 << 22
#: Stands for a missing document id in keys; it sorts after every real id.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Only a local master may leave that unset; it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="simvane-")
        spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/simvane-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)  # results are lazy, so what they read has to stay until the driver ends
    return folder


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df once and reads it back: the result survives lost executors and is not computed again."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_mark(df: DataFrame) -> Column:
    """64 bits of a whole row, null and empty told apart."""
    columns = [df[c] for c in df.columns]
    return F.xxhash64(F.lit(22), *columns, *(c.isNull() for c in columns))


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop file system, path) of a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def drop_folder(spark: SparkSession, path: str) -> None:
    files, target = file_system(spark, path)
    files.delete(target, True)


def integer_id(docs: DataFrame, id_col: str) -> None:
    """Raises unless the column of ids holds integers."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")


def id_or_last(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def text_mark(text: str | Column) -> Column:
    """64 bits of the text; with the id it tells apart rows that repeat an id."""
    return F.xxhash64(F.lit(20), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def tidy() -> None:
    """Gives memory that is no longer used back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and batch.nbytes > BATCH_BYTES:
        half = batch.num_rows // 2
        yield from _cut(batch.slice(0, half))
        yield from _cut(batch.slice(half))
    elif batch.num_rows:
        yield batch


def per_batch(make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that works on pieces of at most BATCH_BYTES, one after another, whatever the session's batches hold."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _cut(batch):
                made = make(piece)
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
        tidy()  # the worker waits for its next task, which may be another operator's

    return over
