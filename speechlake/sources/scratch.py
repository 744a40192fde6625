"""Scratch tables in the folder that all machines share, and global numbering of rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


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


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._speechlake_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing to come reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._speechlake_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "i") -> DataFrame:
    """rows with a number from 0 within ``by`` in the order of ``order``, null keys among themselves.

    Rows are dealt by ranges of the order, and a range is numbered from where the ranges before it end, so that a group
    with most of the rows is no task of its own. ``order`` must tell rows of a group apart for the numbers to be fixed.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = stored(dealt, "numbered")
    ends = dealt.groupBy("_part", *by).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    # a row for each group and range that has some of it
    bases = ends.withColumn("_base", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n") - F.col("_low"))
    bases = bases.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_base")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = dealt.join(bases, same).withColumn(name, F.col("_base") + F.col("_at"))
    return out.drop("_part", "_at", "_p", "_base", *[f"_k{i}" for i in range(len(by))])
