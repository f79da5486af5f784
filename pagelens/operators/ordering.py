"""Tables that are computed once, and global positions in an order without a task that sees all rows."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders of settled tables by owner: those made inside of ``settling``, and at None all others, for ``drop_settled``.
_OWNED: dict[object, list[str]] = {None: []}
_OWNER: ContextVar[object] = ContextVar("owner", default=None)
_LOCK = threading.Lock()
_WRITERS: dict[str, int] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; one of our own only in local mode, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """While tables are written, the files of shuffles go with the execution that made them; the last of several threads resets that."""
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    key = f"{id(spark)}"
    with _LOCK:
        _WRITERS[key] = _WRITERS.get(key, 0) + 1
        if _WRITERS[key] == 1:
            spark._settled_before = spark.conf.get(option, None)
            spark.conf.set(option, "true")
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS[key] -= 1
            if not _WRITERS[key]:
                before = spark._settled_before
                spark.conf.unset(option) if before is None else spark.conf.set(option, before)


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from here on, so that a lost executor costs no lineage.

    The table belongs to the ``settling`` that it is made in, which deletes it when it ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    _OWNED.setdefault(_OWNER.get(), []).append(path)
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, owner: object) -> None:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    paths = _OWNED.get(owner, [])
    while paths:
        path = hadoop.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def drop_settled(spark: SparkSession) -> None:
    """Deletes the tables that were settled outside of ``settling``, once all results that are read from them are written."""
    _drop(spark, None)


@contextmanager
def settling(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that are settled inside of it and deletes them at its end, when what is read from them is to be written.

    Results made outside of it, or in another one, keep their tables.
    """
    owner = object()
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)
        _drop(spark, owner)
        _OWNED.pop(owner, None)


def ranked(df: DataFrame, *keys, name: str = "rank") -> DataFrame:
    """df with its position (from 0) in the order of keys, which should tell different rows apart.

    Rows are dealt into ranges and sorted there; the ranges' sizes, one row each, give where each range begins.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = settled(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    begin = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))
    return dealt.join(F.broadcast(begin), "_part").withColumn(name, F.col("_begin") + F.col("_row")).drop("_part", "_row", "_begin")  # a row for each range
