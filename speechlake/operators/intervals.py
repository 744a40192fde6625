"""Joins and unions of half-open intervals, by time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket: near the length of the longer side's usual interval.
BUCKET_MS = 10_000


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], bucket: int = BUCKET_MS) -> DataFrame:
    """Pairs whose closed spans meet, on equal keys, each pair once.

    Both sides go to the buckets that their spans touch, and are joined on keys and bucket, so Spark plans a hash or
    sort-merge join. Of the buckets that a pair shares, the one where the later of them begins makes the row.
    """
    cell = lambda c: F.floor(c / bucket)
    a = left.withColumns({"_ls": left_span[0], "_le": left_span[1]}).withColumn("_b", F.explode(F.sequence(cell(F.col("_ls")), cell(F.greatest("_ls", "_le")))))
    b = right.withColumns({"_rs": right_span[0], "_re": right_span[1]}).withColumn("_b", F.explode(F.sequence(cell(F.col("_rs")), cell(F.greatest("_rs", "_re")))))
    joined = a.join(b, [*keys, "_b"]).where((F.col("_ls") <= F.col("_re")) & (F.col("_rs") <= F.col("_le")))
    return joined.where(F.col("_b") == cell(F.greatest("_ls", "_rs"))).drop("_b", "_ls", "_le", "_rs", "_re")


def islands(rows: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """keys, start, end: intervals that touch or overlap are one; empty ones count for nothing."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    real = rows.where(F.col(end) > F.col(start))
    marked = real.withColumn("_new", (F.coalesce(F.max(end).over(before) < F.col(start), F.lit(True))).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def union_length(rows: DataFrame, keys: Sequence[str], name: str = "covered_ms") -> DataFrame:
    return islands(rows, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(name))


def overlap_matrix(a: DataFrame, b: DataFrame, keys: Sequence[str], a_key: str, b_key: str, bucket: int = BUCKET_MS) -> DataFrame:
    """keys, a_key, b_key, overlap_ms of the merged interval sets of each pair of owners that meet."""
    left = islands(a, [*keys, a_key]).withColumnsRenamed({"start_ms": "s1", "end_ms": "e1"})
    right = islands(b, [*keys, b_key]).withColumnsRenamed({"start_ms": "s2", "end_ms": "e2"})
    met = range_join(left, right, keys, (F.col("s1"), F.col("e1")), (F.col("s2"), F.col("e2")), bucket)
    return met.groupBy(*keys, a_key, b_key).agg(F.sum(F.greatest(F.lit(0).cast("long"), F.least("e1", "e2") - F.greatest("s1", "s2"))).alias("overlap_ms")).where("overlap_ms > 0")


def attach_points(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, point_id: Sequence[str], order: str, slack: int = 20) -> DataFrame:
    """The points with the first span that holds them (``order`` decides), else the first within the slack, else null."""
    lanes = spans.select(*keys, F.col(order).alias("_o"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    met = range_join(points.select(*keys, *point_id, F.col(at).alias("_at")), lanes, keys, (F.col("_at"), F.col("_at")), (F.col("_s") - slack, F.col("_e") + slack))
    rank = F.struct((~((F.col("_at") >= F.col("_s")) & (F.col("_at") < F.col("_e")))).alias("late"), F.col("_o").alias("o"))
    first = met.groupBy(*keys, *point_id).agg(F.min(rank).alias("_first")).select(*keys, *point_id, F.col("_first.o").alias(f"attached_{order}"), F.col("_first.late").alias("by_slack"))
    return points.join(first, [*keys, *point_id], "left")
