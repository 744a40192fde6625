"""Words and segments to speakers, speaker identity between runs, and diarization scores."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlake.operators.intervals import islands, overlap_matrix, range_join, union_length
from speechlake.sources.scratch import discard, stored

#: How far a word may be from its nearest turn, and the guards of smoothing and review.
NEAREST_GAP_MS, SMOOTH_MARGIN, SMOOTH_MS, MIN_PURITY = 500, 0.6, 400, 0.6
#: What two speakers must share to be one: so much, or that part of the smaller.
MIN_OVERLAP_MS, MIN_OVERLAP_SHARE = 2000, 0.2
WORD = ["run_id", "idx", "word_idx"]


def _ordered_turns(turns: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("start_ms", "end_ms", "idx"))
    return turns.select("run_id", "speaker_key", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"), place.alias("place"))


def _overlap(s: str = "ws", e: str = "we"):
    return F.greatest(F.lit(0).cast("long"), F.least(F.col(e), F.col("te")) - F.greatest(F.col(s), F.col("ts")))


def assign_words(words: DataFrame, turns: DataFrame, gap: int = NEAREST_GAP_MS) -> DataFrame:
    """words with speaker_key, margin, source: overlap summed by speaker; else the nearest turn within the gap; else none.

    Ties go to the speaker whose turn starts first. A word without length counts as 1 ms. A turn that starts exactly
    where the word ends has a negative distance, and so always is the nearest.
    """
    spans = words.select(*WORD, F.col("start_ms").alias("ws"), F.greatest(F.col("end_ms"), F.col("start_ms") + 1).alias("we"))
    met = range_join(spans, _ordered_turns(turns), ["run_id"], (F.col("ws") - gap, F.col("we") + gap), (F.col("ts"), F.col("te")))
    met = met.withColumn("ov", _overlap()).withColumn("dist", F.when(F.col("ts") > F.col("we"), F.col("ts") - F.col("we")).otherwise(F.col("ws") - F.col("te")))
    per = met.where("ov > 0").groupBy(*WORD, "speaker_key").agg(F.sum("ov").alias("ov"), F.min("place").alias("place"))
    ranked = per.groupBy(*WORD).agg(F.sort_array(F.collect_list(F.struct((-F.col("ov")).alias("neg"), "place", "speaker_key"))).alias("r"))
    best, second = -F.col("r")[0]["neg"], F.coalesce(-F.get("r", F.lit(1))["neg"], F.lit(0))
    over = ranked.select(*WORD, F.col("r")[0]["speaker_key"].alias("over"), ((best - second) / (best + second)).alias("over_margin"))
    near = met.where(f"ov = 0 and dist <= {gap}").groupBy(*WORD).agg(F.min_by("speaker_key", F.struct("dist", "place")).alias("near"))
    joined = words.join(over, WORD, "left").join(near, WORD, "left")
    return joined.withColumns({
        "speaker_key": F.coalesce("over", "near"), "margin": F.coalesce("over_margin", F.lit(0.0)),
        "source": F.when(F.col("over").isNotNull(), "overlap").when(F.col("near").isNotNull(), "nearest").otherwise("none")}).drop("over", "near", "over_margin")


def smooth(assigned: DataFrame, margin: float = SMOOTH_MARGIN, most_ms: int = SMOOTH_MS) -> DataFrame:
    """One-word islands between equal neighbours take their speaker, if evidence is weak and the word is short. Reads original labels only."""
    order = Window.partitionBy("run_id").orderBy("start_ms", "end_ms", "idx", "word_idx")
    at = lambda c, n: (F.lag(c) if n < 0 else F.lead(c)).over(order)
    rows = assigned.withColumns({"_p": at("speaker_key", -1), "_n": at("speaker_key", 1), "_pm": at("margin", -1), "_nm": at("margin", 1)})
    flip = F.coalesce((F.col("_p") == F.col("_n")) & (F.col("speaker_key") != F.col("_p")) & (F.col("margin") < margin) & (F.col("end_ms") - F.col("start_ms") < most_ms), F.lit(False))
    return rows.select(*[c for c in assigned.columns if c not in ("speaker_key", "margin", "source")], F.when(flip, F.col("_p")).otherwise(F.col("speaker_key")).alias("speaker_key"),
                       F.when(flip, F.least("_pm", "_nm")).otherwise(F.col("margin")).alias("margin"), F.when(flip, "median").otherwise(F.col("source")).alias("source"))


def interval_fallback(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """run_id, idx, speaker_key, purity: the speaker with most overlap of the segment itself."""
    spans = segments.select("run_id", "idx", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    met = range_join(spans, _ordered_turns(turns), ["run_id"], (F.col("ws"), F.col("we")), (F.col("ts"), F.col("te"))).withColumn("ov", _overlap()).where("ov > 0")
    per = met.groupBy("run_id", "idx", "ws", "we", "speaker_key").agg(F.sum("ov").alias("ov"), F.min("place").alias("place"))
    best = per.groupBy("run_id", "idx", "ws", "we").agg(F.min(F.struct((-F.col("ov")).alias("neg"), "place", "speaker_key")).alias("b"))
    return best.select("run_id", "idx", F.col("b.speaker_key").alias("speaker_key"), F.least(F.lit(1.0), -F.col("b.neg") / F.greatest(F.lit(1).cast("long"), F.col("we") - F.col("ws"))).alias("purity"))


def vote_segments(segments: DataFrame, words: DataFrame, turns: DataFrame, least: float = MIN_PURITY) -> DataFrame:
    """run_id, idx, speaker_key, purity, needs_review, source: a duration-weighted vote of the words, by interval without words."""
    order = Window.partitionBy("run_id", "idx").orderBy("start_ms", "end_ms", "word_idx")
    votes = words.withColumns({"d": F.greatest(F.lit(1).cast("long"), F.col("end_ms") - F.col("start_ms")), "place": F.row_number().over(order)})
    total = votes.groupBy("run_id", "idx").agg(F.sum("d").alias("total"))
    per = votes.where("speaker_key is not null").groupBy("run_id", "idx", "speaker_key").agg(F.sum("d").alias("ms"), F.min("place").alias("place"))
    best = per.groupBy("run_id", "idx").agg(F.min(F.struct((-F.col("ms")).alias("neg"), "place", "speaker_key")).alias("b"))
    voted = total.join(best, ["run_id", "idx"], "left").select("run_id", "idx", F.col("b.speaker_key").alias("voted"), F.coalesce(-F.col("b.neg") / F.col("total"), F.lit(0.0)).alias("share"), F.lit(True).alias("has_words"))
    fallback = interval_fallback(segments, turns).select("run_id", "idx", F.col("speaker_key").alias("by_time"), F.col("purity").alias("time_purity"))
    rows = segments.select("run_id", "idx").join(voted, ["run_id", "idx"], "left").join(fallback, ["run_id", "idx"], "left")
    has = F.coalesce("has_words", F.lit(False))
    return rows.select(
        "run_id", "idx", F.when(has, F.col("voted")).otherwise(F.col("by_time")).alias("speaker_key"), F.when(has, F.col("share")).otherwise(F.coalesce("time_purity", F.lit(0.0))).alias("purity"),
        F.when(has, F.col("voted").isNull() | (F.col("share") < least)).otherwise(True).alias("needs_review"),
        F.when(has & F.col("voted").isNotNull(), "words").when(~has & F.col("by_time").isNotNull(), "interval").otherwise("none").alias("source"))


def reconcile_stats(words: DataFrame, segments: DataFrame) -> DataFrame:
    """run_id, counts of words by source, flips, unassigned words, and the mean purity of word-voted segments."""
    n = lambda s: F.count_if(F.col("source") == s)
    w = words.groupBy("run_id").agg(n("overlap").alias("overlap"), n("nearest").alias("nearest"), n("median").alias("flips"), n("none").alias("unassigned"))
    s = segments.groupBy("run_id").agg(F.avg(F.when(F.col("source") == "words", F.col("purity"))).alias("mean_purity"), F.count_if("needs_review").alias("review"))
    return w.join(s, "run_id", "full")


def speaker_summary(segments: DataFrame, words: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """run_id, speaker_key, segments, words, speech_ms, share of the run's speech; speakers without any are kept."""
    counts = words.groupBy("run_id", "idx").agg(F.count("*").alias("w"))
    own = segments.join(counts, ["run_id", "idx"], "left").groupBy("run_id", "speaker_key").agg(F.count("*").alias("segments"), F.sum(F.coalesce("w", F.lit(0))).alias("words"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    if speakers is not None:
        own = speakers.select("run_id", "speaker_key").distinct().join(own, ["run_id", "speaker_key"], "left").fillna(0, ["segments", "words", "speech_ms"])
    whole = F.sum("speech_ms").over(Window.partitionBy("run_id"))
    return own.withColumn("share", F.col("speech_ms") / F.nullif(whole, F.lit(0).cast("long")))


def assignment(cost: list[list[float]]) -> list[int]:
    """The column of each row in an assignment of least total cost, for a square matrix of whole numbers.

    Rows bid for columns as in an auction. A bid raises the price of a row's best column by its lead over the second
    best and a small step; whoever held the column bids again. Gains are whole multiples of one more than the number of
    rows, so once the step is 1 the total can't be bettered. The first row waiting bids first, for the first of its equally
    good columns, so that equal input has equal output.
    """
    n = len(cost)
    if n < 2:
        return [0] * n
    gain = -np.rint(np.array(cost, np.float64)).astype(np.int64) * (n + 1)
    price, step = np.zeros(n, np.int64), max(1, int(gain.max() - gain.min()) // 4)
    while True:
        holder, waiting = [-1] * n, deque(range(n))
        while waiting:
            row = waiting.popleft()
            left = gain[row] - price
            column = int(left.argmax())
            best, left[column] = left[column], np.iinfo(np.int64).min
            price[column] += best - left.max() + step
            if holder[column] >= 0:
                waiting.append(holder[column])
            holder[column] = row
        if step == 1:
            return sorted(range(n), key=holder.__getitem__)
        step = max(1, step // 5)


def match_speakers(prior: DataFrame, fresh: DataFrame, least_ms: int = MIN_OVERLAP_MS, least_share: float = MIN_OVERLAP_SHARE) -> DataFrame:
    """run_id, fresh_key, prior_key, overlap_ms: one-to-one, of the most overlap in all.

    The overlaps are counted by interval joins; only the matrix of a run's speakers, the square of the people in one
    recording, is solved in one task. A match counts if it reaches least_ms or least_share of the smaller coverage.
    """
    p, f = (d.withColumnRenamed("speaker_key", k) for d, k in ((prior, "prior_key"), (fresh, "fresh_key")))
    met = overlap_matrix(p, f, ["run_id"], "prior_key", "fresh_key")
    cover = lambda d, k, name: union_length(d, ["run_id", k], name)
    cells = met.join(cover(p, "prior_key", "pc"), ["run_id", "prior_key"]).join(cover(f, "fresh_key", "fc"), ["run_id", "fresh_key"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(pdf["fresh_key"])), sorted(set(pdf["prior_key"]))
        n = max(len(rows), len(cols))
        seen = {(f, p): (o, least) for f, p, o, least in zip(pdf["fresh_key"], pdf["prior_key"], pdf["overlap_ms"], pdf[["pc", "fc"]].min(axis=1))}
        cost = [[-float(seen[(rows[i], cols[j])][0]) if i < len(rows) and j < len(cols) and (rows[i], cols[j]) in seen else 0.0 for j in range(n)] for i in range(n)]
        out = []
        for i, j in enumerate(assignment(cost)):
            if i < len(rows) and j < len(cols) and (rows[i], cols[j]) in seen:
                o, least = seen[(rows[i], cols[j])]
                if o >= max(least_ms, least_share * least):
                    out.append((pdf["run_id"].iloc[0], rows[i], cols[j], int(o)))
        return pd.DataFrame(out, columns=["run_id", "fresh_key", "prior_key", "overlap_ms"])

    return cells.groupBy("run_id").applyInPandas(solve, "run_id long, fresh_key string, prior_key string, overlap_ms long")


def unmatched_speakers(matches: DataFrame, prior: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What match_speakers left over: run_id, prior_key of speakers who were not heard again, and run_id, fresh_key, first_ms of new ones."""
    gone = prior.select("run_id", F.col("speaker_key").alias("prior_key")).distinct().join(matches, ["run_id", "prior_key"], "left_anti")
    new = fresh.groupBy("run_id", F.col("speaker_key").alias("fresh_key")).agg(F.min("start_ms").alias("first_ms")).join(matches, ["run_id", "fresh_key"], "left_anti")
    return gone, new


def allocate_keys(existing: DataFrame, unmatched: DataFrame, colours: int = 12) -> DataFrame:
    """run_id, fresh_key, speaker_key, colour: the next speaker-NN after the highest, from 00 where there is none, in order of first appearance."""
    top = existing.groupBy("run_id").agg(F.max(F.regexp_extract("speaker_key", "^speaker-(\\d+)$", 1).try_cast("int")).alias("top"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("first_ms", "fresh_key"))
    rows = unmatched.withColumn("place", place).join(top, "run_id", "left").withColumn("n", F.coalesce("top", F.lit(-1)) + F.col("place"))
    return rows.select("run_id", "fresh_key", F.concat(F.lit("speaker-"), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(2), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("speaker_key"), (F.col("n") % colours).alias("colour"))


def merge_chains(merges: DataFrame, until: int | None = None) -> DataFrame:
    """run_id, at, from_key, into_key, next_at: the log of merges, each with the later one that moves on what it moved; stored.

    merges: run_id, at (order in the run), from_key, into_key; of two with the same ``at`` the one with the smaller
    from_key is first. Merging a speaker with itself is refused. With ``until``, later merges are undone: left out. The
    log is kept as it is, so any prefix of it can be applied again.
    """
    refused = F.raise_error(F.concat(F.lit("a speaker can't be merged with itself: "), F.col("from_key"))).cast("string")
    log = merges.select("run_id", F.col("at").cast("long").alias("at"), "from_key", F.when(F.col("from_key") == F.col("into_key"), refused).otherwise(F.col("into_key")).alias("into_key"))
    log = log.where(F.col("at") <= until) if until is not None else log
    steps = log.withColumn("at", F.row_number().over(Window.partitionBy("run_id").orderBy("at", "from_key", "into_key")))
    # a speaker's arrivals and departures in the order of the log; the next departure moves an arrival on
    times = steps.select("run_id", F.explode(F.array(F.struct(F.col("into_key").alias("key"), "at", F.lit(False).alias("leaves")), F.struct(F.col("from_key").alias("key"), "at", F.lit(True).alias("leaves")))).alias("x")).select("run_id", "x.*")
    later = Window.partitionBy("run_id", "key").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    onward = times.withColumn("next_at", F.min(F.when(F.col("leaves"), F.col("at"))).over(later)).where("not leaves").select("run_id", "at", "next_at")
    return stored(steps.join(onward, ["run_id", "at"]), "merge-chains")


def _first_merges(chains: DataFrame) -> DataFrame:
    """run_id, key, at: the merge that first moves a speaker's own rows."""
    return chains.groupBy("run_id", F.col("from_key").alias("key")).agg(F.min("at").alias("at"))


def final_speakers(chains: DataFrame) -> DataFrame:
    """run_id, key, into_key: where a speaker's own rows end. Merges point at the next one that moves their rows on; pointers double in each round."""
    now = stored(chains.select("run_id", "at", "into_key", F.col("next_at").alias("to"), F.lit(False).alias("_moved")), "merge-ends")
    while True:
        far = now.select("run_id", F.col("at").alias("to"), F.col("into_key").alias("_into"), F.col("to").alias("_to"), F.lit(True).alias("_met"))
        jumped = now.join(far, ["run_id", "to"], "left").select("run_id", "at", F.coalesce("_into", "into_key").alias("into_key"), F.when(F.col("_met"), F.col("_to")).alias("to"), F.coalesce("_met", F.lit(False)).alias("_moved"))
        jumped = stored(jumped, "merge-ends")
        discard(now)
        now = jumped
        if now.where("to is not null").isEmpty():
            return _first_merges(chains).join(now, ["run_id", "at"]).select("run_id", "key", "into_key")


def merge_by_log(rows: DataFrame, merges: DataFrame, until: int | None = None) -> DataFrame:
    """rows (run_id, speaker_key, ...) as the log of merges leaves them, chains followed in the order of time; merged_from is the key that a moved row had."""
    ends = final_speakers(merge_chains(merges, until)).withColumnRenamed("key", "speaker_key")
    return rows.join(ends, ["run_id", "speaker_key"], "left").withColumns({"merged_from": F.when(F.col("into_key").isNotNull(), F.col("speaker_key")), "speaker_key": F.coalesce("into_key", "speaker_key")}).drop("into_key")


def moved_counts(merges: DataFrame, until: int | None = None, **tables: DataFrame) -> DataFrame:
    """run_id, at (place in the run's log, from 1), from_key, into_key, and for each table <name>_moved: the rows that the merge moved, those included that earlier merges had brought to its speaker."""
    chains = merge_chains(merges, until)
    out = chains.select("run_id", "at", "from_key", "into_key")
    for name, rows in tables.items():
        own = rows.groupBy("run_id", F.col("speaker_key").alias("key")).agg(F.count("*").alias("n"))
        wave = stored(_first_merges(chains).join(own, ["run_id", "key"]).select("run_id", "at", "n"), "merge-wave")
        waves = [wave]
        while True:  # as often as the longest chain; rows of a merge are added before they move on
            wave = stored(chains.join(waves[-1], ["run_id", "at"]).where("next_at is not null").groupBy("run_id", F.col("next_at").alias("at")).agg(F.sum("n").alias("n")), "merge-wave")
            if wave.isEmpty():
                break
            waves.append(wave)
        total = waves[0]
        for more in waves[1:]:
            total = total.unionByName(more)
        total = stored(total.groupBy("run_id", "at").agg(F.sum("n").alias(f"{name}_moved")), "merge-moved")
        out = out.join(total, ["run_id", "at"], "left").fillna({f"{name}_moved": 0})
    return out


def merge_speakers(turns: DataFrame, merges: DataFrame) -> DataFrame:
    """turns with merged keys replaced. merges: run_id, from_key, into_key; merging a speaker with itself is refused."""
    refused = F.raise_error(F.concat(F.lit("a speaker can't be merged with itself: "), F.col("from_key"))).cast("string")
    real = merges.select("run_id", F.col("from_key").alias("speaker_key"), F.when(F.col("from_key") == F.col("into_key"), refused).otherwise(F.col("into_key")).alias("into_key"))
    return turns.join(real, ["run_id", "speaker_key"], "left").withColumns({"merged_from": F.when(F.col("into_key").isNotNull(), F.col("speaker_key")), "speaker_key": F.coalesce("into_key", "speaker_key")}).drop("into_key")


def slices(*sides: DataFrame) -> DataFrame:
    """run_id, s, e: the elementary intervals between all boundaries of all sides."""
    edges = None
    for d in sides:
        own = d.select("run_id", F.explode(F.array("start_ms", "end_ms")).alias("s"))
        edges = own if edges is None else edges.unionByName(own)
    order = Window.partitionBy("run_id").orderBy("s")
    return edges.distinct().withColumn("e", F.lead("s").over(order)).where("e is not null")


def diarization_error(reference: DataFrame, hypothesis: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """run_id, total, miss, false_alarm, confusion, der over elementary intervals; der can pass 1. A run without reference speech is an error."""
    mapping = match_speakers(reference, hypothesis, 0, 0.0).select("run_id", "fresh_key", "prior_key") if mapping is None else mapping
    cuts = slices(reference, hypothesis)
    active = lambda d, name: range_join(cuts, islands(d, ["run_id", "speaker_key"]), ["run_id"], (F.col("s"), F.col("e") - 1), (F.col("start_ms"), F.col("end_ms") - 1)).select("run_id", "s", "e", F.col("speaker_key").alias(name)).distinct()
    ref, hyp = active(reference, "prior_key"), active(hypothesis, "fresh_key")
    right = hyp.join(mapping, ["run_id", "fresh_key"]).join(ref, ["run_id", "s", "e", "prior_key"]).groupBy("run_id", "s", "e").agg(F.count("*").alias("ok"))
    n = lambda d, name: d.groupBy("run_id", "s", "e").agg(F.count("*").alias(name))
    per = n(ref, "r").join(n(hyp, "h"), ["run_id", "s", "e"], "full").join(right, ["run_id", "s", "e"], "left").fillna(0, ["r", "h", "ok"]).withColumn("d", F.col("e") - F.col("s"))
    zero = F.lit(0).cast("long")
    out = per.groupBy("run_id").agg(F.sum(F.col("d") * F.col("r")).alias("total"), F.sum(F.col("d") * F.greatest(zero, F.col("r") - F.col("h"))).alias("miss"),
                                    F.sum(F.col("d") * F.greatest(zero, F.col("h") - F.col("r"))).alias("false_alarm"), F.sum(F.col("d") * (F.least("r", "h") - F.col("ok"))).alias("confusion"))
    none = F.raise_error(F.concat(F.lit("no reference speech in run "), F.col("run_id").cast("string"))).cast("long")
    return out.withColumn("der", (F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.when(F.col("total") > 0, F.col("total")).otherwise(none))


def jaccard_error(reference: DataFrame, hypothesis: DataFrame, mapping: DataFrame) -> DataFrame:
    """run_id, jer: mean over reference speakers of 1 - intersection / union with the mapped speaker; an unmapped speaker counts 1."""
    r, h = reference.withColumnRenamed("speaker_key", "prior_key"), hypothesis.withColumnRenamed("speaker_key", "fresh_key")
    met = overlap_matrix(r, h, ["run_id"], "prior_key", "fresh_key").join(mapping.select("run_id", "fresh_key", "prior_key"), ["run_id", "prior_key", "fresh_key"])
    rows = union_length(r, ["run_id", "prior_key"], "rc").join(met, ["run_id", "prior_key"], "left").join(union_length(h, ["run_id", "fresh_key"], "hc"), ["run_id", "fresh_key"], "left")
    error = F.coalesce(1 - F.col("overlap_ms") / (F.col("rc") + F.col("hc") - F.col("overlap_ms")), F.lit(1.0))
    return rows.groupBy("run_id").agg(F.avg(error).alias("jer"))


def frame_error(reference: DataFrame, hypothesis: DataFrame, mapping: DataFrame, frame_ms: int = 10) -> DataFrame:
    """run_id, frames, miss, confusion, false_alarm by frames with exactly the first speaker of each."""
    def frames(d: DataFrame, name: str) -> DataFrame:
        first, end = F.ceil(F.col("start_ms") / frame_ms), F.ceil(F.col("end_ms") / frame_ms)
        # speech between two frames has none; a sequence would count down there
        spans = islands(d, ["run_id", "speaker_key"]).where(first < end).withColumn("f", F.explode(F.sequence(first, end - 1)))
        return spans.groupBy("run_id", "f").agg(F.min("speaker_key").alias(name))

    both = frames(reference.where("end_ms > start_ms"), "prior_key").join(frames(hypothesis.where("end_ms > start_ms"), "fresh_key"), ["run_id", "f"], "full")
    m = mapping.select("run_id", "fresh_key", F.col("prior_key").alias("mapped"))
    both = both.join(m, ["run_id", "fresh_key"], "left")
    r, h = F.col("prior_key").isNotNull(), F.col("fresh_key").isNotNull()
    return both.groupBy("run_id").agg(F.count_if(r).alias("frames"), F.count_if(r & ~h).alias("miss"), F.count_if(r & h & ~F.coalesce(F.col("mapped") == F.col("prior_key"), F.lit(False))).alias("confusion"), F.count_if(~r & h).alias("false_alarm"))


def change_points(turns: DataFrame) -> DataFrame:
    """run_id, at: starts of turns whose speaker differs from the turn before."""
    order = Window.partitionBy("run_id").orderBy("start_ms", "end_ms", "idx")
    return turns.withColumn("_p", F.lag("speaker_key").over(order)).where("_p is not null and _p <> speaker_key").select("run_id", F.col("start_ms").alias("at"))


def boundary_error(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """run_id, changes, median_ms (the upper one), max_ms: distance of every reference change to the nearest hypothesis change.

    Changes of both sides are put in one order by time; the nearest is the last before or the first after.
    """
    marks = change_points(reference).withColumn("h", F.lit(None).cast("long")).unionByName(change_points(hypothesis).withColumn("h", F.col("at")))
    order = Window.partitionBy("run_id").orderBy("at")
    rows = marks.withColumns({"b": F.last("h", True).over(order.rangeBetween(Window.unboundedPreceding, 0)), "a": F.first("h", True).over(order.rangeBetween(0, Window.unboundedFollowing))}).where("h is null")
    near = rows.withColumn("d", F.least(F.col("at") - F.col("b"), F.col("a") - F.col("at")))
    d = near.where("d is not null").groupBy("run_id").agg(F.sort_array(F.collect_list("d")).alias("d"))
    return d.select("run_id", F.size("d").alias("changes"), F.get("d", F.floor(F.size("d") / 2).cast("int")).alias("median_ms"), F.array_max("d").alias("max_ms"))
