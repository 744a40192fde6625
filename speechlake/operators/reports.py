"""Tables of the reports: translations with their controls, script failures, what samples are. Stale reviews are those of registry.reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlake.operators.evaluation import MIN_INTEGRITY
from speechlake.operators.operations import first_by
from speechlake.operators.shuffling import seeded_shuffle

#: Roles of a translation run's languages, in the order of its table (fixed values).
ROLES = ["ceiling", "bar", "measured"]
#: What a reader must know of a sample (fixed values).
ONE_GROUP = ("Every clip in this sample is ", "; the split cannot show speaker concentration.")
FEW_SENTENCES = (" clips cover ", " distinct sentences.")
UNMATCHED = " fetched clip(s) had no reference text and were dropped."


def joined_sentences(source: DataFrame, target: DataFrame, by: str, keys: Sequence[str], order: Sequence[str], n: int | None = None, seed: int = 1) -> DataFrame:
    """Sentences of each language that the target has too: source's columns, those of target beside keys and order, and joined, the language's number of them.

    Of rows that repeat their keys the first in order counts, on both sides; a null key meets nothing. With n, which
    needs one key, the first n of the language's seeded shuffle are kept, and joined is still the number before that.
    """
    once = first_by(source, [by, *keys], order).drop("copies", *order)
    other = first_by(target, keys, order).drop("copies", *order)
    rows = once.join(other, list(keys))
    counts = rows.groupBy(by).agg(F.count("*").alias("joined"))
    if n is not None:
        if len(keys) != 1:
            raise ValueError("a sample is drawn by one key")
        rows = seeded_shuffle(rows, [by], keys[0], n, seed).drop("rank")
    return rows.join(counts, by)


def translation_report(scores: DataFrame, counts: DataFrame, asked: Sequence[str], target: str, bar: str, models: Sequence[str], errors: DataFrame | None = None, code: str = "lang") -> DataFrame:
    """place, code, role, model, joined, n, chrf, ceiling, bar, at_bar, error: one row for each language asked for and model.

    scores: code, model, chrf; counts: code, joined, n; errors: code, error. Two controls are in every table: the target
    translated into itself is the ceiling, and a language that is good enough is the bar; both come first. Their scores
    are those of the first model, and at_bar tells a score that reaches the bar's. A language with an error has no
    numbers. A score that is absent is null.
    """
    wanted = [*dict.fromkeys([*asked, target, bar])]
    role = lambda c: "ceiling" if c == target else "bar" if c == bar else "measured"
    places = sorted(wanted, key=lambda c: ROLES.index(role(c)))
    cells = [(i, c, role(c), m, k) for i, c in enumerate(places) for k, m in enumerate(models)]
    rows = scores.sparkSession.createDataFrame(cells, f"place int, {code} string, role string, model string, _k int")
    rows = rows.join(counts.select(code, "joined", "n"), code, "left").join(scores.select(code, "model", "chrf"), [code, "model"], "left")
    rows = rows.join(errors.select(code, "error"), code, "left") if errors is not None else rows.withColumn("error", F.lit(None).cast("string"))
    rows = rows.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("joined", "n", "chrf")})
    # as many rows as languages times models
    whole = Window.partitionBy(F.lit(0))
    control = lambda name: F.max(F.when((F.col("role") == name) & (F.col("_k") == 0), F.col("chrf"))).over(whole)
    rows = rows.withColumns({"ceiling": control("ceiling"), "bar": control("bar")})
    return rows.select("place", code, "role", "model", "joined", "n", "chrf", "ceiling", "bar", (F.col("chrf") >= F.col("bar")).alias("at_bar"), "error")


def integrity_failures(rows: DataFrame, examples: DataFrame, code: str = "lang", floor: float = MIN_INTEGRITY) -> DataFrame:
    """code, integrity, cer, ref, hyp: languages whose letters fall short of the floor, with a clip as it was, not normalised; without one those are null. An unknown integrity is no failure."""
    return rows.where(F.col("integrity") < floor).select(code, "integrity", "cer").join(examples.select(code, "ref", "hyp"), code, "left")


def worst_examples(pairs: DataFrame, by: str, order: Sequence[str], edits: str = "edits", total: str = "ref_len") -> DataFrame:
    """by, ref, hyp of the clip with the highest rate of each group; of equal ones the first in order. Clips without a reference come last."""
    own = F.coalesce(F.col(edits) / F.nullif(F.col(total), F.lit(0).cast("long")), F.lit(-1.0))
    best = pairs.groupBy(by).agg(F.min_by(F.struct("ref", "hyp"), F.struct((-own).alias("r"), *order)).alias("e"))
    return best.select(by, "e.ref", "e.hyp")


def sample_notes(described: DataFrame, by: str = "lang", unmatched: DataFrame | None = None) -> DataFrame:
    """by, notes of samples that a reader must know more of: all clips of one group, fewer sentences than clips, clips without a reference.

    described is that of sample_description, whose groups are a map; unmatched: by, unmatched, a number of clips. Samples
    without a note have no row, and an empty sample has no note of its clips.
    """
    rows = described.join(unmatched.select(by, "unmatched"), by, "full") if unmatched is not None else described.withColumn("unmatched", F.lit(0))
    text = lambda c: F.col(c).cast("string")
    one = F.when(F.col("uniform") & (F.col("clips") > 0), F.concat(F.lit(ONE_GROUP[0]), F.coalesce(F.map_keys("groups")[0].cast("string"), F.lit("one gender")), F.lit(ONE_GROUP[1])))
    few = F.when(F.col("distinct_ids") < F.col("clips"), F.concat(text("clips"), F.lit(FEW_SENTENCES[0]), text("distinct_ids"), F.lit(FEW_SENTENCES[1])))
    lost = F.when(F.col("unmatched") > 0, F.concat(text("unmatched"), F.lit(UNMATCHED)))
    return rows.select(by, F.concat_ws(" ", one, few, lost).alias("notes")).where("notes <> ''")
