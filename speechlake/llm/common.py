"""What the operators share: reading tables, shared scratch tables, text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local session may do without, others may not."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = getattr(spark, "_speechlake_shared", None)
    if own is None:
        own = f"file://{tempfile.mkdtemp(prefix='speechlake-')}"
        spark._speechlake_shared = own
    return own


#: Makes Spark drop an execution's shuffle files as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors. The shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._speechlake_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing to come reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._speechlake_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark's cleaner drops the shuffle files of jobs that are done.

    Between the jobs of one operator nothing else makes it do so before the disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives freed memory back to the system once it is through. A worker lives on for the next stage, and what it held would count beside what the executor needs then."""
    def through(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return through


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), with a null text as the empty one. Every other column, whatever its name, is left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def mark_of(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits that tell apart rows that differ in id or text; rows with equal ones are one document."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))))


def places(marks: DataFrame) -> DataFrame:
    """mark, doc_id, key of a table (mark, doc_id): distinct marks, numbered from 0 by rising id (null last), then mark.

    Ranges of the order are numbered on their own, from where the ranges before them end. The table is stored.
    """
    spark = marks.sparkSession
    order = [F.col("doc_id").isNull(), "doc_id", "mark"]
    dealt = marks.select("mark", "doc_id").distinct().repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = stored(dealt.select("mark", "doc_id", F.spark_partition_id().alias("part"), local.alias("at")), "places-dealt")
    ends = dealt.groupBy("part").agg((F.max("at") + 1).alias("n"))  # a row for each range
    bases = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    out = stored(dealt.join(bases, "part").select("mark", "doc_id", (F.col("base") + F.col("at")).alias("key")), "places")
    discard(dealt)
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, mark, text, stored: one row for each distinct pair of id and text, numbered as in places.

    A null text is the empty one; other columns, whatever their names, are left out. Rows that share an id but not the
    text are documents of their own, and so is a row without an id, after all others.
    """
    rows = text_of(docs, id_col, text_col).withColumn("mark", mark_of())
    one = rows.groupBy("mark").agg(F.first("text").alias("text"))
    at = places(rows.select("mark", "doc_id"))
    out = stored(one.join(at, "mark").select("key", "doc_id", "mark", "text"), "documents-keyed")
    discard(at)
    release(docs.sparkSession)
    return out


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
