"""Scripts of texts by a dictionary of code-point ranges, which is a table.

A table (script, lo, hi) may hold any number of scripts, and scripts may share ranges. Its bounds are cut into disjoint
intervals in order, each with the scripts it belongs to; they go to the tasks as arrays, and all code points of a batch
of texts are searched in them at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as text for integrity: letters and marks. A set of this name is in every table that scripts_table makes.
LETTERS = "letters"
#: Ranges that a dictionary may have; they are held by every task.
MOST_RANGES = 100_000


def scripts_table(spark: SparkSession, scripts: dict[str, Sequence[str]]) -> DataFrame:
    """script, lo, hi for each of ``scripts``: code to the names of the character properties that make it, of which the table of all code points has the islands; and those of letters and marks."""
    patterns = {code: "[" + "".join(f"\\p{{Is{name}}}" for name in names) + "]" for code, names in scripts.items()} | {LETTERS: "[\\p{L}\\p{M}]"}
    points = spark.range(0x110000).where("id < 55296 or id > 57343")
    character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    met = points.select("id", character.alias("c")).select("id", F.explode(F.array_compact(F.array(*[F.when(F.col("c").rlike(f"^{p}$"), code) for code, p in patterns.items()]))).alias("script"))
    # within a script, points of one island have the same distance to their place; blocks of points keep the windows small
    block = F.floor(F.col("id") / 4096)
    place = F.row_number().over(Window.partitionBy("script", block).orderBy("id"))
    islands = met.withColumns({"_b": block, "_i": F.col("id") - place}).groupBy("script", "_b", "_i").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return islands.select("script", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))


@dataclass(frozen=True)
class Dictionary:
    """Names in order; starts of disjoint intervals, and for each the names that it belongs to (the first starts at 0)."""

    names: tuple[str, ...]
    starts: np.ndarray
    member: np.ndarray

    def places(self, points: np.ndarray) -> np.ndarray:
        """The interval of each code point."""
        return np.searchsorted(self.starts, points, side="right") - 1


def dictionary(ranges: DataFrame) -> Dictionary:
    """The dictionary of a table of ranges; one that is empty, or out of order, or beyond Unicode is an error."""
    rows = ranges.select("script", "lo", "hi").limit(MOST_RANGES + 1).collect()
    if len(rows) > MOST_RANGES:
        raise ValueError(f"a dictionary takes {MOST_RANGES} ranges at most")
    if bad := [r for r in rows if r.script is None or r.lo is None or r.hi is None or not 0 <= r.lo <= r.hi <= 0x10FFFF]:
        raise ValueError(f"no range of code points: {tuple(bad[0])}")
    names = tuple(sorted({r.script for r in rows}))
    starts = np.unique(np.array([0, *[r.lo for r in rows], *[r.hi + 1 for r in rows]], np.int64))
    # a range opens at its first interval and closes after its last; open ones are counted along the intervals
    opened, at = np.zeros((len(starts) + 1, len(names)), np.int64), {n: i for i, n in enumerate(names)}
    for r in rows:
        opened[np.searchsorted(starts, r.lo), at[r.script]] += 1
        opened[np.searchsorted(starts, r.hi + 1), at[r.script]] -= 1
    return Dictionary(names, starts, np.cumsum(opened, 0)[:-1] > 0)


def _points(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a batch, and the row of each. Null is empty."""
    plain = [t if isinstance(t, str) else "" for t in texts]
    raw = [t.encode("utf-32-le", "surrogatepass") for t in plain]
    return np.frombuffer(b"".join(raw), np.uint32).astype(np.int64), np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])


def script_counts(text: Column, d: Dictionary) -> Column:
    """map of script to characters, for the scripts that a text has some of."""
    @F.pandas_udf("map<string,long>")
    def count(texts: pd.Series) -> pd.Series:
        points, row = _points(texts)
        key, n = np.unique(row * len(d.starts) + d.places(points), return_counts=True)
        out: list[dict[str, int]] = [{} for _ in range(len(texts))]
        for r, place, many in zip((key // len(d.starts)).tolist(), (key % len(d.starts)).tolist(), n.tolist()):
            for i in np.flatnonzero(d.member[place]):
                out[r][d.names[i]] = out[r].get(d.names[i], 0) + many
        return pd.Series(out, dtype=object)

    return count(text)


def script_integrity(text: Column, accepted: Column, d: Dictionary) -> Column:
    """struct(counted, in_script, fraction, strays) of a text, given the array of scripts that its language accepts.

    Counted are letters and marks, in_script those in an accepted script; strays are the first eight others, each once.
    The fraction is null where nothing counts. A script that the dictionary lacks accepts nothing, and so does null.
    """
    shape = "struct<counted:long,in_script:long,fraction:double,strays:array<string>>"

    @F.pandas_udf(shape)
    def judge(texts: pd.Series, scripts: pd.Series) -> pd.DataFrame:
        letters, at = d.member[:, d.names.index(LETTERS)], {n: i for i, n in enumerate(d.names)}
        points, row = _points(texts)
        place = d.places(points)
        sets = [tuple(sorted(s for s in (x if x is not None else ()) if s in at)) for x in scripts]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(sets))}
        inside = np.array([d.member[:, [at[x] for x in s]].any(1) if s else np.zeros(len(d.starts), bool) for s in kinds]) if kinds else np.zeros((0, len(d.starts)), bool)
        counted = letters[place]
        own = counted & inside[np.array([kinds[s] for s in sets], np.int64)[row], place] if len(points) else counted
        strays: list[list[str]] = [[] for _ in range(len(texts))]
        off = np.flatnonzero(counted & ~own)
        _, first = np.unique(row[off] * 0x110000 + points[off], return_index=True)
        for i in np.sort(off[first]):
            if len(strays[row[i]]) < 8:
                strays[row[i]].append(chr(points[i]))
        n, m = (np.bincount(row[x], minlength=len(texts)) for x in (counted, own))
        return pd.DataFrame({"counted": n, "in_script": m, "fraction": pd.Series(np.divide(m, n, out=np.full(len(texts), np.nan), where=n > 0)).astype(object).where(n > 0, None), "strays": strays})

    return judge(text, accepted)


def accepted_scripts(rows: DataFrame, registry: DataFrame, code: str = "lang") -> DataFrame:
    """rows with accepted, the primary and the alternative scripts of their language; registry: code, script, alt_scripts. An unknown language accepts none."""
    known = registry.select(F.col("code").alias(code), F.concat(F.array("script"), F.coalesce("alt_scripts", F.array().cast("array<string>"))).alias("accepted"))
    return rows.join(known, code, "left").withColumn("accepted", F.coalesce("accepted", F.array().cast("array<string>")))
