"""Corpus error rates, intervals, tiers, comparisons and regression gates over text pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.functions import metrics as M
from speechlake.functions import text as T
from speechlake.sources.scratch import numbered, stored

#: Thresholds of the tiers and of the editing gate.
VERIFIED_CER, VERIFIED_RATIO, VERIFIED_N = 0.2, 1.15, 30
BETA_CER, BETA_RATIO, UNSUPPORTED_CER, MIN_INTEGRITY = 0.35, 2.0, 0.6, 0.8
MAX_CONTENT_DELTA, MAX_ENTITY_DRIFT, MAX_BASELINE_DRIFT = 0.005, 0.02, 0.25
TIER_ORDER = ["verified", "beta", "experimental", "unsupported"]


def scored(pairs: DataFrame, **profile) -> DataFrame:
    """pairs with h and r, the scoring forms, and edits and ref_len of them."""
    both = pairs.withColumns({"h": T.scoring_form(F.col("hyp"), **profile), "r": T.scoring_form(F.col("ref"), **profile)})
    return both.withColumns({"edits": M.char_edits(F.col("h"), F.col("r")), "ref_len": F.length("r").cast("long")})


def corpus_rate(stats: DataFrame, by: Sequence[str], edits: str = "edits", total: str = "ref_len", name: str = "cer") -> DataFrame:
    """Sum of edits over sum of lengths, never the mean of rates."""
    return stats.groupBy(*by).agg(F.count("*").alias("n"), F.sum(edits).alias("edits"), F.sum(total).alias("total")).withColumn(name, M.rate(F.col("edits"), F.col("total")))


def word_stats(pairs: DataFrame, hyp: str = "h", ref: str = "r") -> DataFrame:
    counted = pairs.withColumn("_words", M.word_counts(F.col(hyp), F.col(ref)))
    return counted.withColumns({"word_edits": F.col("_words.edits"), "ref_words": F.col("_words.words")}).drop("_words")


def corpus_chrf(pairs: DataFrame, by: Sequence[str], hyp: str = "hyp", ref: str = "ref", char_order: int = 6, word_order: int = 0, beta: float = 2.0) -> DataFrame:
    """by, chrf: statistics are summed over all pairs, and scored once. Only sums are shuffled."""
    c = M.ngram_stats(char_order)(M.packed(F.col(hyp)), M.packed(F.col(ref)))
    counted = pairs.select(*by, c.alias("c"), *([M.ngram_stats(word_order, True)(M.edge_words(F.col(hyp)), M.edge_words(F.col(ref))).alias("w")] if word_order else []))
    kinds = [("c", n) for n in range(char_order)] + [("w", n) for n in range(word_order)]
    sums = counted.groupBy(*by).agg(*[F.sum(F.get(k, F.lit(3 * n + i))).alias(f"{k}{n}_{i}") for k, n in kinds for i in range(3)])
    return sums.select(*by, M.chrf([tuple(F.col(f"{k}{n}_{i}") for i in range(3)) for k, n in kinds], beta).alias("chrf"))


def _uniform(seed: int, draws: np.ndarray) -> np.ndarray:
    """Draws of text.seeded_uniform, by number."""
    m = np.uint32
    state = m(seed & 0xFFFFFFFF) + draws.astype(np.uint32) * m(0x6D2B79F5)
    a = state ^ (state >> m(15))
    t = a * (state | m(1))
    t = t ^ (t + (t ^ (t >> m(7))) * (t | m(61)))
    return (t ^ (t >> m(14))) / 4294967296.0


#: Clips of a group that a task holds whole, resamples that it draws, draws made at once.
BOOT_BLOCK, BOOT_RESAMPLES, BOOT_DRAWS = 1 << 20, 50, 1 << 20
#: Of larger groups: clips of a block, and resamples whose draws meet it in one task.
BOOT_PART, BOOT_MEET = 1 << 17, 100


def bootstrap(stats: DataFrame, by: str, order: str, b: int = 2000, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """by, n, lo, hi: percentile interval of the ratio of sums, resampling clips with the seeded generator.

    Clips are numbered in the order of ``order``, which tells them apart; draw k * n + i + 1 picks clip i of resample k.
    Every draw is made once, so work is b * n. The clips of a group of up to BOOT_BLOCK go whole to the tasks that draw
    its resamples, and only sums are shuffled. Draws of a larger group are made by blocks of their numbers and sent, four
    bytes each, to the block of clips that they picked. A group without a key has a null one.
    """
    numbers = numbered(stats.select(by, order, "edits", "ref_len"), [by], [order])
    sizes = numbers.groupBy(by).agg(F.count("*").alias("n"))
    clips = numbers.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    kind = dict(stats.dtypes)[by]
    sums = _held_draws(clips.where(F.col("n") <= BOOT_BLOCK), by, kind, b, seed)
    sums = sums.unionByName(_sent_draws(clips.where(F.col("n") > BOOT_BLOCK), sizes.where(F.col("n") > BOOT_BLOCK), by, kind, b, seed))
    ratio = F.when(F.col("t") > 0, F.col("e") / F.col("t")).otherwise(0.0)
    sorted_ = sums.groupBy(by, "n").agg(F.sort_array(F.collect_list(ratio)).alias("s"))
    lo, hi = int(alpha / 2 * b), min(b - 1, -int(-(1 - alpha / 2) * b // 1) - 1)
    return sorted_.select(by, "n", F.get("s", F.lit(lo)).alias("lo"), F.get("s", F.lit(hi)).alias("hi"))


def _held_draws(clips: DataFrame, by: str, kind: str, b: int, seed: int) -> DataFrame:
    """by, n, k, e, t: sums of resamples of groups that fit a task whole."""
    whole = clips.groupBy(by, "n").agg(F.array_sort(F.collect_list(F.struct("i", "edits", "ref_len"))).alias("x"))
    work = whole.select(by, "n", F.col("x.edits").alias("e"), F.col("x.ref_len").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(b - 1), F.lit(BOOT_RESAMPLES))).alias("k0"))
    resamples, draws = BOOT_RESAMPLES, BOOT_DRAWS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, n, e, t, k0 in zip(pdf[by], pdf["n"], pdf["e"], pdf["t"], pdf["k0"]):
                out = []
                for k in range(k0, min(k0 + resamples, b)):
                    se = st = 0
                    for j in range(0, n, draws):
                        at = _picked(seed, n, k, j, min(j + draws, n))
                        se, st = se + int(e[at].sum()), st + int(t[at].sum())
                    out.append((key, n, k, se, st))
                yield pd.DataFrame(out, columns=[by, "n", "k", "e", "t"])

    return work.repartition(by, "k0").mapInPandas(run, f"{by} {kind}, n long, k int, e long, t long")


def _sent_draws(clips: DataFrame, sizes: DataFrame, by: str, kind: str, b: int, seed: int) -> DataFrame:
    """by, n, k, e, t: sums of resamples of groups of any size, whose draws are made elsewhere than their clips stand."""
    part, meet, step = BOOT_PART, BOOT_MEET, BOOT_DRAWS
    # one task makes a block of draws of some resamples at a time; (n, k, j) are a row of three numbers
    blocks = sizes.select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("k")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("j"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, n, k, j in zip(pdf[by], pdf["n"], pdf["k"], pdf["j"]):
                at = np.sort(_picked(seed, n, k, j, min(j + step, n)))
                low = np.arange(at[0] // part, at[-1] // part + 2)
                cut = np.searchsorted(at, low * part)
                out = [(key, int(p), k // meet, k, (at[x:z] - p * part).astype(np.uint32).tobytes()) for p, x, z in zip(low, cut, cut[1:]) if x < z]
                yield pd.DataFrame(out, columns=[by, "block", "some", "k", "at"])

    # by number, as rows so small would be put together into one task
    parallel = int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = blocks.repartition(parallel, by, "k", "j").mapInPandas(draw, f"{by} {kind}, block long, some int, k int, at binary")
    held = clips.select(by, "n", "i", "edits", "ref_len", F.floor(F.col("i") / part).alias("block"), F.explode(F.sequence(F.lit(0), F.lit((b - 1) // meet))).alias("some"))

    def add(clip: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
        e, t = np.zeros(part, np.int64), np.zeros(part, np.int64)
        place = clip["i"].to_numpy() % part
        e[place], t[place] = clip["edits"].to_numpy(), clip["ref_len"].to_numpy()
        out = []
        for k, at in zip(picks["k"], picks["at"]):
            at = np.frombuffer(at, np.uint32)
            out.append((clip[by].iloc[0], clip["n"].iloc[0], k, int(e[at].sum()), int(t[at].sum())))
        return pd.DataFrame(out, columns=[by, "n", "k", "e", "t"])

    keys = [by, "block", "some"]
    parts = held.groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInPandas(add, f"{by} {kind}, n long, k int, e long, t long")
    return parts.groupBy(by, "n", "k").agg(F.sum("e").alias("e"), F.sum("t").alias("t"))


def _picked(seed: int, n: int, k: int, low: int, high: int) -> np.ndarray:
    """Clips of draws low to high of resample k of n clips."""
    return np.floor(_uniform(seed, k * n + np.arange(low, high, dtype=np.int64) + 1) * n).astype(np.int64)


def poisson_bootstrap(stats: DataFrame, by: str, key: str, b: int = 200, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """by, poisson_lo, poisson_hi: one pass over any number of clips, each in resample k as often as a Poisson draw of its key."""
    u = (F.xxhash64(F.col(key), F.col("k"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    cdf, p, weight = 0.0, 0.36787944117144233, F.lit(0)
    for n in range(8):
        cdf += p
        weight, p = weight + (u > cdf).cast("int"), p / (n + 1)
    rows = stats.select(by, key, "edits", "ref_len", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("k")).withColumn("w", weight)
    sums = rows.groupBy(by, "k").agg(F.sum(F.col("edits") * F.col("w")).alias("e"), F.sum(F.col("ref_len") * F.col("w")).alias("t")).where("t > 0")
    return sums.groupBy(by).agg(F.percentile_approx(F.col("e") / F.col("t"), [alpha / 2, 1 - alpha / 2]).alias("q")).select(by, F.col("q")[0].alias("poisson_lo"), F.col("q")[1].alias("poisson_hi"))


def baseline_ratio(rates: DataFrame, code: str, baseline: str, value: str = "cer", run: Sequence[str] = ()) -> DataFrame:
    """ratio to the baseline row of the same run; null if that is null or 0."""
    base = rates.where(F.col(code) == baseline).select(*run, F.col(value).alias("base"))
    # without runs there is one row to send; a row for each run is joined as their number asks
    joined = rates.join(base, list(run), "left") if run else rates.crossJoin(F.broadcast(base.agg(F.max("base").alias("base"))))
    return joined.withColumn("ratio", F.col(value) / F.nullif(F.col("base"), F.lit(0.0))).drop("base")


def tier(cer: Column, ci_hi: Column, ratio: Column, integrity: Column, n: Column, reviewed: Column, code_rejected: Column | None = None, no_eval_set: Column | None = None) -> Column:
    """struct(tier, reason, blocked): ordered gates first, then everything that keeps a language from being verified."""
    no = F.lit(False)
    rejected, no_set = (no if c is None else F.coalesce(c, no) for c in (code_rejected, no_eval_set))
    result = lambda t, reason, *blocked: F.struct(F.lit(t).alias("tier"), F.lit(reason).alias("reason"), F.array(*map(F.lit, blocked)).cast("array<string>").alias("blocked"))
    base = cer / ratio
    blocked = F.array_compact(F.array(
        F.when(ratio.isNull() | (ratio > VERIFIED_RATIO), f"ratio>{VERIFIED_RATIO}"), F.when(cer > VERIFIED_CER, f"cer>{VERIFIED_CER}"), F.when(n < VERIFIED_N, f"n<{VERIFIED_N}"),
        F.when(ci_hi.isNull(), "ciHi>0.20").when(ci_hi > VERIFIED_CER, f"ciHi>{VERIFIED_CER}"),
        F.when(ci_hi.isNotNull() & (cer > 0) & (ratio > 0) & (base > 0) & (ci_hi / base > VERIFIED_RATIO), "ciHiRatio>1.15"), F.when(~F.coalesce(reviewed, no), "humanReview")))
    level = F.when(F.size(blocked) == 0, "verified").when((ratio <= BETA_RATIO) & (cer <= BETA_CER), "beta").otherwise("experimental")
    return (F.when(rejected, result("unsupported", "code-rejected", "code-rejected")).when(no_set, result("experimental", "no-eval-set", "no-eval-set"))
            .when(cer.isNull(), result("experimental", "not-run", "not-run")).when(integrity < MIN_INTEGRITY, result("unsupported", "script-integrity", f"scriptIntegrity<{MIN_INTEGRITY}"))
            .when(cer > UNSUPPORTED_CER, result("unsupported", "measured", f"cer>{UNSUPPORTED_CER}"))
            .otherwise(F.struct(level.alias("tier"), F.lit("measured").alias("reason"), blocked.alias("blocked"))))


def script_integrity(texts: DataFrame, keys: Sequence[str], text: str, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """keys, counted, in_script, fraction, strays: letters and marks inside accepted code-point ranges; null if nothing counts."""
    accepted = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)
    c = F.col(text)
    stray = F.regexp_extract_all(c, F.lit(f"[\\p{{L}}\\p{{M}}&&[^{accepted}]]"), F.lit(0))
    counted, inside = T.count_of(c, "\\p{L}\\p{M}"), T.count_of(c, f"\\p{{L}}\\p{{M}}&&[{accepted}]")
    return texts.select(*keys, counted.alias("counted"), inside.alias("in_script"), (inside / F.nullif(counted, F.lit(0).cast("long"))).alias("fraction"), F.slice(F.array_distinct(stray), 1, 8).alias("strays"))


#: Scripts of the census and their code-point blocks (fixed values).
CENSUS = {"Latn": "\\p{IsLatin}", "Cyrl": "\\p{IsCyrillic}", "Grek": "\\p{IsGreek}", "Arab": "\\p{IsArabic}", "Hani": "\\p{IsHan}", "Hira": "\\p{IsHiragana}", "Kana": "\\p{IsKatakana}", "Hang": "\\p{IsHangul}", "Deva": "\\p{IsDevanagari}", "Mymr": "\\p{IsMyanmar}"}


def with_majority_script(texts: DataFrame, text: str, name: str = "script") -> DataFrame:
    """Adds the script with most characters (the first of ties); Japanese and Korean texts absorb Han. Null without any."""
    # all scripts but Latin are looked for in what is not ASCII
    rest = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    counted = texts.withColumn("_rest", rest).withColumns({f"_{s}": T.count_of(F.col(text if s == "Latn" else "_rest"), p) for s, p in CENSUS.items()})
    kana, hang, hani = F.col("_Hira") + F.col("_Kana"), F.col("_Hang"), F.col("_Hani")
    counted = counted.withColumns({"_Jpan": F.when(kana > 0, kana + hani).otherwise(0), "_Kore": F.when(hang > 0, hang + hani).otherwise(0)})
    order = ["Jpan", "Kore", *[s for s in CENSUS if s not in ("Hira", "Kana", "Hang")]]
    best = F.sort_array(F.array(*[F.struct(F.col(f"_{s}").alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(order)]), False)[0]
    return counted.withColumn("_top", best).withColumn(name, F.when(F.col("_top.n") > 0, F.col("_top.s"))).drop("_top", "_rest", "_Jpan", "_Kore", *[f"_{s}" for s in CENSUS])


def script_census(texts: DataFrame, by: str, text: str, alternate: float = 0.02) -> DataFrame:
    """by, script, rows, share, role (primary, alternate from 2 % of rows, or trace)."""
    # a condition on the script itself would be pushed before the counting, and count everything again
    counts = with_majority_script(texts, text).groupBy(by, "script").agg(F.count("script").alias("rows")).where("rows > 0")
    whole = Window.partitionBy(by)
    share = F.col("rows") / F.sum("rows").over(whole)
    place = F.row_number().over(whole.orderBy(F.desc("rows"), "script"))
    return counts.select(by, "script", "rows", share.alias("share"), F.when(place == 1, "primary").when(share >= alternate, "alternate").otherwise("trace").alias("role"))


def language_summary(stats: DataFrame, by: str = "lang", key: str = "id") -> DataFrame:
    """Everything of a language in one row, with its worst clip (of ties the last)."""
    own = F.when(F.col("ref_len") > 0, F.col("edits") / F.col("ref_len"))
    return stats.withColumn("own", own).groupBy(by).agg(
        F.count("*").alias("n"), F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_len"), M.rate(F.sum("edits"), F.sum("ref_len")).alias("cer"),
        F.max_by(key, F.struct(F.coalesce("own", F.lit(-1.0)), key)).alias("worst_id"), F.max("own").alias("worst_cer"))


def language_report(summary: DataFrame, tiers: DataFrame, by: str = "lang") -> DataFrame:
    """language_summary with the interval's upper end, ratio, integrity, tier, reason and what blocks the language; a language that was summed up but has no tier row keeps nulls."""
    return summary.join(tiers.select(by, "ci_hi", "ratio", "integrity", "tier", "reason", "blocked"), by, "left")


def sample_description(rows: DataFrame, by: Sequence[str], key: str, group: str, samples: str, per_second: int = 16000) -> DataFrame:
    """Clips, distinct ids, counts by group as a map, whether the group is uniform, and seconds."""
    parts = rows.groupBy(*by, group).agg(F.count("*").alias("c"), F.sum(samples).alias("s"))
    ids = rows.groupBy(*by).agg(F.countDistinct(key).alias("distinct_ids"))
    out = parts.groupBy(*by).agg(F.sum("c").alias("clips"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(group, "c")))).alias("groups"), (F.sum("s") / per_second).alias("seconds"))
    return out.join(ids, list(by)).withColumn("uniform", F.size("groups") == 1)


def cleanup_stats(pairs: DataFrame, latin: bool = True) -> DataFrame:
    """Of each editing result (given, hyp, ref): edits with punctuation against the reference, content edits and drift against what was given.

    Content is compared without case, punctuation and any white space: an editing pass may set those, and nothing else.
    """
    keep = {"keep_punctuation": True, "case_fold": False}
    bare = lambda c: T.collapse_space(T.scoring_form(F.col(c)), remove=True)
    rows = pairs.withColumns({"hp": T.scoring_form(F.col("hyp"), **keep), "rp": T.scoring_form(F.col("ref"), **keep), "hc": bare("hyp"), "gc": bare("given")})
    rows = rows.withColumns({"edits_p": M.char_edits(F.col("hp"), F.col("rp")), "len_p": F.length("rp").cast("long"), "edits_c": M.char_edits(F.col("hc"), F.col("gc")), "len_c": F.length("gc").cast("long"),
                             "delta_len": (F.length("hyp") - F.length("given")).cast("long"), "len_in": F.length("given").cast("long")})
    return entity_drift(rows.withColumns({"ents_in": T.entities(F.col("given"), latin), "ents_out": T.entities(F.col("hyp"), latin)}))


def entity_drift(rows: DataFrame, before: str = "ents_in", after: str = "ents_out") -> DataFrame:
    """rows with drift, total, lost: multiset difference of two token lists, the first one's tokens, and those of them that are gone or fewer."""
    i, o = F.col(before), F.col(after)
    count = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    drift = F.aggregate(F.array_distinct(F.concat(i, o)), F.lit(0), lambda n, t: n + F.abs(count(i, t) - count(o, t)))
    return rows.withColumns({"drift": drift.cast("long"), "total": F.size(i).cast("long"), "lost": F.sort_array(F.filter(F.array_distinct(i), lambda t: count(o, t) < count(i, t)))})


def cleanup_aggregate(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ratios of sums, null on 0. A segment without entities counts as one, so that their ratio is never of 0."""
    return stats.groupBy(*by).agg(
        F.count("*").alias("n"), M.rate(F.sum("edits_p"), F.sum("len_p")).alias("cer_punct"), M.rate(F.sum("edits_c"), F.sum("len_c")).alias("content_delta"), M.rate(F.sum("delta_len"), F.sum("len_in")).alias("length_delta"),
        F.count_if(F.col("edits_c") > 0).alias("rewritten"), M.rate(F.sum("drift"), F.sum(F.greatest(F.lit(1).cast("long"), "total"))).alias("entity_drift"))


def rewritten_examples(stats: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 2) -> DataFrame:
    """The n segments of each arm with most edits of content, equal ones in the order of segments, with place; segments without edits are none."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("edits_c"), *order))
    return stats.where("edits_c > 0").withColumn("place", place).where(F.col("place") <= n)


def arm_results(stats: DataFrame, by: Sequence[str], order: Sequence[str], failures: DataFrame | None = None, b: int = 2000, seed: int = 1) -> DataFrame:
    """by, the columns of cleanup_aggregate, lo and hi of cer_punct, examples, entities_lost, failed, failure: one row for each arm.

    stats: cleanup_stats with by and order, which tells the segments of an arm apart. Examples are the two segments with
    most edits of content, each with its order, input and output; entities_lost are all tokens that some segment lost,
    sorted. failures: by, failed (segments without a reply), failure (what was said); an arm that has only failures has
    n 0 and no rates.
    """
    # a key and a number in one column each, as the interval asks for; neither is null
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in by])
    needed = ["edits_p", "len_p", "edits_c", "len_c", "delta_len", "len_in", "drift", "total", "lost", "given", "hyp"]
    rows = stored(stats.select(key.alias("_key"), *by, *order, *needed), "arm-segments")
    numbers = numbered(rows.select("_key", *order, F.col("edits_p").alias("edits"), F.col("len_p").alias("ref_len")), ["_key"], order, "_nth")
    interval = bootstrap(numbers, "_key", "_nth", b=b, seed=seed).select("_key", "lo", "hi")
    out = cleanup_aggregate(rows, ["_key", *by]).join(interval, "_key", "left")
    top = rewritten_examples(rows, ["_key"], order).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("place", *order, F.col("given").alias("input"), F.col("hyp").alias("output")))).alias("examples"))
    lost = rows.select("_key", F.explode("lost").alias("t")).distinct().groupBy("_key").agg(F.sort_array(F.collect_list("t")).alias("entities_lost"))
    out = out.join(top, "_key", "left").join(lost, "_key", "left")
    if failures is not None:
        told = failures.withColumn("_key", key).select("_key", *[F.col(c).alias(f"_told_{c}") for c in by], "failed", "failure")
        out = out.join(told, "_key", "full").withColumns({c: F.coalesce(c, f"_told_{c}") for c in by}).drop(*[f"_told_{c}" for c in by])
    else:
        out = out.withColumns({"failed": F.lit(0).cast("long"), "failure": F.lit(None).cast("string")})
    none = F.array().cast("array<string>")
    filled = {"n": F.coalesce("n", F.lit(0).cast("long")), "failed": F.coalesce(F.col("failed").cast("long"), F.lit(0).cast("long")), "entities_lost": F.coalesce("entities_lost", none), "examples": F.coalesce("examples", F.array().cast(top.schema["examples"].dataType))}
    return out.withColumns(filled).drop("_key")


def cleanup_gate(arms: DataFrame, control: str, wanted: Sequence[str], languages: DataFrame | None = None, models: Sequence[str] = ("",)) -> DataFrame:
    """lang, arm, model, failure, value, against, delta, example, entities_lost, reason: failures against the do-nothing control of the language, worst first.

    arms are those of arm_results; model, examples, entities_lost and failure may be absent. A language (of
    ``languages``, or that has arms) that lacks a measured arm of those wanted, for each of the models, is one failure,
    with the language's error or else what an arm said as reason; so is one without a measured control. Neither is
    looked into further. Else every arm is judged by its rate against the control's, and by its content and entity
    changes against fixed limits, and shown with its first example. languages may say error, and has_set: one without an
    evaluation set and without an error is no failure.
    """
    asked, none = [a for a in wanted if a != control], F.lit(None).cast("double")
    have = lambda df, name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    example = F.get("examples", F.lit(0)) if "examples" in arms.columns else F.lit(None).cast("struct<input:string,output:string>")
    rows = arms.select("lang", "arm", have(arms, "model", "string").alias("model"), "n", "cer_punct", "content_delta", "entity_drift", example.alias("example"), F.coalesce(have(arms, "entities_lost", "array<string>"), F.array().cast("array<string>")).alias("entities_lost"), have(arms, "failure", "string").alias("said"))
    other = F.col("arm") != control
    per = rows.groupBy("lang").agg(F.count_if(other & (F.col("n") > 0)).alias("scored"), F.max(F.when(~other, F.col("cer_punct"))).alias("control"), F.min(F.when(other, F.struct("arm", "model"))).alias("first"), F.min("said").alias("said"))
    if languages is not None:
        named = languages.select("lang", have(languages, "error", "string").alias("error"), F.coalesce(have(languages, "has_set", "boolean"), F.lit(True)).alias("has_set")).distinct()
        per = named.join(per, "lang", "left").where("has_set or error is not null")
    else:
        per = per.withColumn("error", F.lit(None).cast("string"))
    short = F.coalesce(F.col("scored"), F.lit(0)) < len(asked) * len(models)
    per = per.withColumn("failure", F.when(short, "not_measured").when(F.col("first").isNotNull() & F.col("control").isNull(), "control_missing"))
    empty, all_models = F.array().cast("array<string>"), F.lit(",".join(models)) if any(models) else F.lit(None).cast("string")
    lone = per.where("failure is not null").select(
        "lang", F.when(short, ",".join(asked)).otherwise(F.col("first.arm")).alias("arm"), F.when(short, all_models).otherwise(F.col("first.model")).alias("model"), "failure", none.alias("value"), none.alias("against"),
        F.lit(None).cast(rows.schema["example"].dataType).alias("example"), empty.alias("entities_lost"), F.when(short, F.coalesce("error", "said")).alias("reason"))
    judged = rows.where(other).join(per.where("failure is null and first is not null").select("lang", "control"), "lang")
    limits = {"cer_punct": F.col("control"), "content_delta": F.lit(MAX_CONTENT_DELTA), "entity_drift": F.lit(MAX_ENTITY_DRIFT)}
    cases = F.array(*[F.struct(F.lit(name).alias("failure"), F.col(name).cast("double").alias("value"), limit.cast("double").alias("against")) for name, limit in limits.items()])
    failed = judged.select("lang", "arm", "model", F.explode(F.filter(cases, lambda c: c["value"] > c["against"])).alias("c"), "example", "entities_lost")
    failed = failed.select("lang", "arm", "model", "c.failure", "c.value", "c.against", "example", "entities_lost", F.lit(None).cast("string").alias("reason"))
    out = lone.unionByName(failed).withColumn("delta", F.col("value") - F.col("against"))
    return out.orderBy(F.desc(F.coalesce("delta", F.lit(0.0))), "lang", "arm", "model", "failure")


def report_rows(rows: DataFrame, code: str = "lang") -> DataFrame:
    """rows with place from 0: by tier from the best to the worst, then by ratio, unknown ones last, then by code. A report has a row for each language."""
    level = F.array_position(F.array(*map(F.lit, TIER_ORDER)), F.col("tier"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.when(level > 0, level).otherwise(len(TIER_ORDER) + 1), F.col("ratio").asc_nulls_last(), code)) - 1)


def blocked_queue(rows: DataFrame, code: str = "lang") -> DataFrame:
    """code, blocker, only: one row for each thing that keeps a measured language from being verified; only: nothing else does. What was not measured, or fails by script or by its code, is no work for a reviewer."""
    return rows.where("tier <> 'verified' and reason = 'measured'").select(code, F.explode("blocked").alias("blocker"), (F.size("blocked") == 1).alias("only"))


def tier_changes(previous: DataFrame, following: DataFrame, key: str = "lang") -> DataFrame:
    """key, after, cer_after, before, cer_before, why, change: changed or new tiers (key, tier, cer, reason, blocked), by key; what has gone is no change."""
    before = previous.select(key, F.col("tier").alias("before"), F.col("cer").alias("cer_before"))
    joined = following.select(key, F.col("tier").alias("after"), F.col("cer").alias("cer_after"), "reason", "blocked").join(before, key, "left").where(~F.col("before").eqNullSafe(F.col("after")))
    why = (F.when(F.col("before").isNull(), F.concat(F.lit("first measurement — "), F.col("reason"))).when(F.col("reason") == "script-integrity", "script integrity below the floor").when(F.col("reason") == "no-eval-set", "no eval set for this language")
           .when(F.size("blocked") > 0, F.concat(F.lit("blocked by "), F.array_join("blocked", ", "))).otherwise("cleared every verified gate"))
    joined = joined.withColumn("why", why).drop("reason", "blocked")
    order = lambda c: F.array_position(F.array(*map(F.lit, TIER_ORDER)), F.col(c))
    return joined.withColumn("change", F.when(F.col("before").isNull(), "new").when(order("after") < order("before"), "promoted").otherwise("demoted"))


def publish(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New measurements replace those of their key, but for rows with an error; all others are carried over."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.where("error is null").withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))).where("_r = 1").drop("_r", "_new")
