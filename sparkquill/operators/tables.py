"""Intermediate tables: written once in the shared folder, and inputs dealt over all cores."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Inputs of fewer bytes a core are dealt anew, as their files may have too few parts for all cores.
SMALL_PART = 32 << 20


@functools.cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="quill-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all machines share, spark.checkpoint.dir. Where that is unset a session of one machine gets a local
    folder, which goes with the process; on a cluster it's an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(base or _local_folder()).rstrip('/')}/quill-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends, not when the driver happens to collect garbage. The session's own setting
    is back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again. It's worked out once however often it's used, lost executors lose
    none of it, and its size is known: Spark broadcasts it in joins only if it is small."""
    path = scratch(df.sparkSession)
    with _shuffles_cleared(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evenly(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all cores by a hash of the key if it's small (a file of one row group is one task otherwise); else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores, key) if size < SMALL_PART * cores else df


def in_order(df: DataFrame, key: str, number: str) -> DataFrame:
    """df with the rows' numbers from 0 in the order of the key, which no two rows share.

    Ranges of the key are sorted and written first: their bounds come from a sample, so a second evaluation could draw other ones. Counts of
    the written ranges then give each range its first number, and no task sorts all rows.
    """
    ranged = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    ranged = settled(ranged.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(key))))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")  # a row for each range
    return ranged.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_k") - 1).alias(number), *df.columns)


def _file(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str, once: bool = False) -> None:
    """A small file by way of Spark's file systems. once: an error if there is one of this name already."""
    where, fs = _file(spark, path)
    out = fs.create(where, not once)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return spark.read.text(path, wholetext=True).first().value


def file_names(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds, sorted; none if there is no such folder."""
    where, fs = _file(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file, if it is there."""
    where, fs = _file(spark, path)
    fs.delete(where, True)


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """What tasks have written to a folder as one file, in the order of the files' names; the folder goes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where, fs = _file(spark, path)
    fs.delete(where, True)
    out = fs.create(where, True)
    for name in file_names(spark, folder):
        if name.startswith("part-"):
            part, own = _file(spark, f"{folder}/{name}")
            source = own.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
    out.close()
    remove_path(spark, folder)
