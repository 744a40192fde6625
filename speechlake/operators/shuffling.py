"""Seeded samples that equal a sequential shuffle, without walking it.

The walk swaps place i with place j(i) <= i, from the last place down, and a draw is a function of its number, so every
j is known at once. What stands at place i when its turn comes was put there by the last swap before it that drew i, or
stood there from the start; that swap's value in turn stood at its own place when its turn came. Following these
pointers to their roots, by pointer jumping in rounds that double what is skipped, gives the place of origin of any
result, and no round holds more than the rows of a table in any task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlake.functions import text as T
from speechlake.operators.operations import first_by
from speechlake.sources.scratch import discard, numbered, stored


def _rooted(pointers: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, i, root from by, i, to: where each chain ends. Stored; the number of rounds is that of doublings of the longest chain."""
    now = stored(pointers.select(*by, "i", "to"), "pointers")
    while True:
        to = now.select(*by, F.col("i").alias("to"), F.col("to").alias("_far"))
        jumped = now.join(to, [*by, "to"], "left").select(*by, "i", F.coalesce("_far", "to").alias("to"), F.col("_far").isNotNull().alias("_moved"))
        jumped = stored(jumped, "pointers")
        discard(now)
        now = jumped
        if now.where("_moved").isEmpty():
            return now.select(*by, "i", F.col("to").alias("root"))


def swaps(rows: DataFrame, by: Sequence[str], seed: int) -> DataFrame:
    """rows (by, i from 0) with j, the place that the walk swaps place i with, and after, the next higher place that drew the same j."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    drawn = T.seeded_uniform(rows.join(sizes, list(by)), seed, F.col("_n") - F.col("i"), "_u")
    drawn = drawn.withColumn("j", F.when(F.col("i") > 0, F.floor(F.col("_u") * (F.col("i") + 1))).otherwise(0).cast("long"))
    # a place is drawn about as often as the logarithm of the rows at most, so no window is large
    return drawn.withColumn("after", F.lead("i").over(Window.partitionBy(*by, "j").orderBy("i"))).drop("_n", "_u")


def seeded_shuffle(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int = 1) -> DataFrame:
    """The first n rows of each stratum's seeded shuffle, with their rank from 1.

    Of rows that repeat a key one stays; the others are put in the order of the key (null first) and shuffled by the
    walk described above. Strata may be null; with fewer than n rows a stratum is given whole.
    """
    strata = [f"_b{k}" for k in range(len(by))]
    unique = first_by(df, [*by, key], [key]).drop("copies")
    named = unique.withColumn("_b", F.lit(0)).withColumns({s: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for s, c in zip(strata, by)})
    strata = strata or ["_b"]
    placed = stored(numbered(named, strata, [key], "i"), "shuffle-placed")
    drawn = stored(swaps(placed.select(*strata, "i"), strata, seed), "shuffle-drawn")
    pointers = drawn.where("j < i").groupBy(*strata, "j").agg(F.min("i").alias("to")).withColumnRenamed("j", "i")
    roots = _rooted(pointers, strata)
    wanted = drawn.where(F.col("i") < n).select(*strata, (F.col("i") + 1).cast("int").alias("rank"), F.coalesce("after", "j").alias("i"), F.col("after").isNotNull().alias("_chained"))
    found = wanted.join(roots, [*strata, "i"], "left").select(*strata, "rank", F.when(F.col("_chained"), F.coalesce("root", "i")).otherwise(F.col("i")).alias("i"))
    return placed.join(found, [*strata, "i"]).drop("i", "_b", *strata)
