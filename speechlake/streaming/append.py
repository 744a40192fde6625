"""An append-only log whose rows get an increasing sequence number, written from a stream.

A micro-batch takes the numbers that follow those of the batches before it. Its rows are written first, under the
batch's number, then its range, as one file; a reader sees the rows of batches that have a range. A batch that is run
again writes over what it left, unless its range is there: then it is done. So no number is missing or given twice,
wherever a run stops, and as a batch is numbered in ranges of its order no task holds all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.sources.scratch import numbered

RANGES = "low long, n long, batch long"


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """batch, low, n of every batch that is done."""
    return spark.read.schema(RANGES).json(f"{path}/ranges").where("batch >= 0")


def append_batch(rows: DataFrame, batch: int, path: str, order: Sequence[str], written: Callable[[], None] = lambda: None) -> None:
    """Add the rows of a micro-batch; ``written`` is called between the rows and their range."""
    spark = rows.sparkSession
    mark(spark, path, -1, 0, 0)
    done = ranges(spark, path).agg(F.coalesce(F.max(F.when(F.col("batch") < batch, F.col("low") + F.col("n"))), F.lit(0)), F.coalesce(F.bool_or(F.col("batch") == batch), F.lit(False))).first()
    if done[1]:
        return
    at = f"{path}/rows/batch={batch}"
    numbered(rows.withColumn("_all", F.lit(0)), ["_all"], order, "seq").withColumn("seq", F.col("seq") + done[0]).drop("_all").write.mode("overwrite").parquet(at)
    written()
    mark(spark, path, batch, done[0], spark.read.parquet(at).count())


def mark(spark: SparkSession, path: str, batch: int, low: int, n: int) -> None:
    """Write a batch's range. Batch -1 makes the folder."""
    row = spark.range(1).select(F.lit(low).cast("long").alias("low"), F.lit(n).cast("long").alias("n"))
    row.coalesce(1).write.mode("ignore" if batch < 0 else "overwrite").json(f"{path}/ranges/batch={batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """seq and the rows of every batch that is done."""
    return spark.read.parquet(f"{path}/rows").join(ranges(spark, path).select("batch"), "batch", "left_semi").drop("batch")


def append_stream(stream: DataFrame, path: str, checkpoint: str, order: Sequence[str], written: Callable[[], None] = lambda: None) -> None:
    """Append all that a stream has now. ``order`` must tell the rows of a batch apart; nulls come first."""
    def add(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            append_batch(rows, batch, path, order, written)
        finally:
            rows.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
