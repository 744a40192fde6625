"""Languages, scripts and providers: lookups, integrity, choices, and the history of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(rows: DataFrame, key: str, override: DataFrame, measured: DataFrame, seed: DataFrame, value: str = "tier") -> DataFrame:
    """rows with the value and its source: an override, else what was measured, else the seed."""
    out = rows
    for name, d in (("override", override), ("measured", measured), ("seed", seed)):
        out = out.join(d.select(key, F.col(value).alias(f"_{name}")), key, "left")
    source = F.when(F.col("_override").isNotNull(), "override").when(F.col("_measured").isNotNull(), "measured").when(F.col("_seed").isNotNull(), "seed")
    return out.withColumns({value: F.coalesce("_override", "_measured", "_seed"), "source": source}).drop("_override", "_measured", "_seed")


def supported_by(languages: DataFrame, capabilities: DataFrame, provider: str, exclusive: bool = False) -> DataFrame:
    """Languages that a provider accepts; exclusive: that no other one does."""
    ok = capabilities.where("accepted")
    out = languages.join(ok.where(F.col("provider") == provider), "code", "left_semi")
    return out.join(ok.where(F.col("provider") != provider), "code", "left_anti") if exclusive else out


def provider_code(rows: DataFrame, capabilities: DataFrame, languages: DataFrame, provider: str) -> DataFrame:
    """rows with provider_code and failure: an unknown language and a pair that was never probed are different failures."""
    c = capabilities.where(F.col("provider") == provider).select("code", "accepted", "provider_code", F.lit(True).alias("_probed"))
    known = languages.select("code", F.lit(True).alias("_known"))
    out = rows.join(known, "code", "left").join(c, "code", "left")
    failure = F.when(F.col("_known").isNull(), "unknown language").when(F.col("_probed").isNull(), "never probed").when(~F.col("accepted"), "rejected")
    return out.withColumns({"failure": failure, "provider_code": F.when(failure.isNull(), F.col("provider_code"))}).drop("_known", "_probed", "accepted")


def chosen_provider(capabilities: DataFrame, ranking: Sequence[str], preferred: Sequence[str] = (), forced: str | None = None, need_word_timing: bool = False) -> DataFrame:
    """code, provider: a forced one, else the preferred in order, else usable ones, suspects last, by rank."""
    rows = capabilities.where("accepted")
    if need_word_timing:
        rows = rows.where("word_timing")
    if forced:
        return rows.where(F.col("provider") == forced).select("code", "provider")
    place = lambda names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("provider")), F.lit(0).cast("long")), F.lit(len(names) + 1).cast("long"))
    order = Window.partitionBy("code").orderBy(place(list(preferred)), F.col("suspect"), place(list(ranking)), "provider")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("code", "provider")


def overlaid(base: DataFrame, patch: DataFrame, keys: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    """Base rows with the fields of hand patches over them; a patch without a base makes a row from the defaults."""
    p = patch.withColumnsRenamed({c: f"_{c}" for c in patch.columns if c not in keys})
    joined = base.join(p, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(F.col(f"_{c}"), F.col(c), d).alias(c) for c, d in defaults.items()])


def resolved_languages(entries: DataFrame, seed: DataFrame, measured: DataFrame, override: DataFrame) -> DataFrame:
    """entries with tier, tier_source, enabled, cer, cer_ratio, n, human_reviewed, notes of each language.

    entries: code and whatever else a language has; seed: code, tier, enabled, human_reviewed, notes; measured: code,
    tier, cer, cer_ratio, n, human_reviewed, notes; override: code and any of the columns added, null where it says
    nothing. An override stands before what was measured, that before the seed; whether a language is enabled is not
    measured. Notes of a measurement and of the seed are joined, as both stay true, unless an override has its own. Rows
    of a code that is no entry are ignored.
    """
    tiers = lambda d: d.select("code", "tier")
    out = cascade(entries, "code", tiers(override), tiers(measured), tiers(seed)).withColumnRenamed("source", "tier_source")
    kinds = {"enabled": "boolean", "cer": "double", "cer_ratio": "double", "n": "long", "human_reviewed": "boolean", "notes": "string"}
    for name, d in (("_o", override), ("_m", measured), ("_s", seed)):
        out = out.join(d.select("code", F.struct(*[(F.col(c).cast(k) if c in d.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]).alias(name)), "code", "left")
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    both = F.nullif(F.concat_ws(" ", said("_m.notes"), said("_s.notes")), F.lit(""))
    values = {c: F.coalesce(f"_o.{c}", f"_m.{c}", f"_s.{c}") for c in kinds} | {"enabled": F.coalesce("_o.enabled", "_s.enabled"), "notes": F.coalesce("_o.notes", both)}
    return out.withColumns(values).drop("_o", "_m", "_s")


def filtered_languages(languages: DataFrame, capabilities: DataFrame, tiers: Sequence[str] = (), enabled: bool = False, script: str | None = None, provider: str | None = None, not_by: str | None = None, exclusive_to: str | None = None) -> DataFrame:
    """Languages that meet all conditions given: one of the tiers, enabled, a script, accepted by a provider, not accepted by one, accepted by one alone."""
    ok = capabilities.where("accepted")
    out = languages.where(F.col("tier").isin(*tiers)) if tiers else languages
    out = out.where("enabled") if enabled else out
    out = out.where(F.col("script") == script) if script else out
    out = supported_by(out, capabilities, provider) if provider else out
    out = out.join(ok.where(F.col("provider") == not_by), "code", "left_anti") if not_by else out
    return supported_by(out, capabilities, exclusive_to, exclusive=True) if exclusive_to else out


def scoring_profiles(languages: DataFrame, scripts: DataFrame) -> DataFrame:
    """code, script, segmentation, legacy_encoding, zwnj, zwj, native_digits, strip_space, letterlike: how texts of each language are scored.

    languages: code, script, segmentation, legacy_encoding, strip_space; scripts: script, zwnj, zwj (whether those are
    stripped), native_digits. A language of an unknown script has no profile. No language lists signs that it writes as
    letters, which are therefore empty and not guessed.
    """
    known = languages.join(scripts.select("script", "zwnj", "zwj", "native_digits"), "script")
    return known.select("code", "script", "segmentation", "legacy_encoding", "zwnj", "zwj", "native_digits", "strip_space", F.array().cast("array<string>").alias("letterlike"))


def range_faults(ranges: DataFrame) -> DataFrame:
    """script, lo of code-point ranges that are empty, out of order, or overlap the one before."""
    before = F.lag("hi").over(Window.partitionBy("script").orderBy("lo", "hi"))
    return ranges.withColumn("_b", before).where((F.col("lo") > F.col("hi")) | (F.col("_b") >= F.col("lo"))).select("script", "lo")


#: What providers say when they do not have a language.
UNSUPPORTED = ["not supported", "unsupported language", "invalid.*language", "language.*invalid", "language code .*(not recognized|not recognised)", "bad language code"]


def call_outcome(status: Column, body: Column) -> Column:
    """2xx is accepted; 400 with words that mean an unknown language is rejected, else an error; others are unknown."""
    unknown_language = F.coalesce(body, F.lit("")).rlike(f"(?i){'|'.join(UNSUPPORTED)}")
    return F.when(status.between(200, 299), "accepted").when((status == 400) & unknown_language, "rejected").when(status == 400, "error").otherwise("unknown")


def capability_roll_up(attempts: DataFrame, previous: DataFrame) -> DataFrame:
    """code, status, supported, models, word_timing of each language of a provider.

    attempts: code, model, outcome, word_timing (null: not seen); previous: code, status, supported, models, word_timing.
    Any accepted attempt accepts: its models count, and word timing is true if one had it, false if one lacked it, else
    unknown. All rejected reject. Otherwise nothing was learned: the status says error or unknown, the rest stays as it
    was. A code that was not tried stays as a whole.
    """
    yes, none = F.col("outcome") == "accepted", F.array().cast("array<string>")
    a = attempts.groupBy("code").agg(F.bool_or(yes).alias("any"), F.bool_and(F.col("outcome") == "rejected").alias("none"), F.bool_or(F.col("outcome") == "error").alias("error"), F.sort_array(F.collect_set(F.when(yes, F.col("model")))).alias("_models"), F.bool_or(F.when(yes, F.col("word_timing"))).alias("_timing"))
    p = previous.select("code", F.col("status").alias("_s"), "supported", "models", "word_timing")
    out, tried = a.join(p, "code", "full"), F.col("any").isNotNull()
    learned = lambda new, old, rejected: F.when(~tried, old).when(F.col("any"), new).when(F.col("none"), rejected).otherwise(old)
    return out.select(
        "code", F.when(~tried, F.col("_s")).when(F.col("any"), "accepted").when(F.col("none"), "rejected").when(F.col("error"), "error").otherwise("unknown").alias("status"),
        learned(F.lit(True), F.coalesce("supported", F.lit(False)), F.lit(False)).alias("supported"), F.coalesce(learned(F.col("_models"), F.col("models"), none), none).alias("models"),
        learned(F.col("_timing"), F.col("word_timing"), F.lit(None).cast("boolean")).alias("word_timing"))


def previous_baseline(runs: DataFrame, same: Sequence[str]) -> DataFrame:
    """runs with the baseline of the latest earlier run that is alike, and whether it drifted by over a quarter."""
    w = Window.partitionBy(*same).orderBy("finished_at", "run_id")
    out = runs.withColumn("previous", F.lag("baseline").over(w))
    return out.withColumn("suspect", F.coalesce(F.abs(F.col("baseline") / F.nullif(F.col("previous"), F.lit(0.0)) - 1) > 0.25, F.lit(False)))


def language_rows(measurements: DataFrame, choice: DataFrame, languages: DataFrame) -> DataFrame:
    """code, provider, tier, others: the chosen provider's row sets the tier, the rest are listed; without any there is a not-run row."""
    rows = measurements.join(choice.select("code", F.col("provider").alias("_c")), "code", "left")
    w = Window.partitionBy("code").orderBy(F.desc(F.coalesce(F.col("provider") == F.col("_c"), F.lit(False))), "provider")
    rows = rows.withColumn("_r", F.row_number().over(w))
    best = rows.where("_r = 1").select("code", "provider", "tier")
    others = rows.where("_r > 1").groupBy("code").agg(F.sort_array(F.collect_list("provider")).alias("others"))
    out = languages.select("code").join(best, "code", "left").join(others, "code", "left")
    return out.select("code", "provider", F.coalesce("tier", F.lit("not-run")).alias("tier"), F.coalesce("others", F.array().cast("array<string>")).alias("others"))


def replayed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, n, edits, total, cer, error of a run log's summary lines, and its usd and whether it is complete.

    Rates are made anew from score lines, but a language that ended in an error keeps what its summary says: its clips are
    only those that were bought before. Without score lines the summary's own numbers stay. A run with a footer is
    complete and its total counts; else what was spent is the sum over asr lines.
    """
    made = lines.where("t = 'score'").groupBy("lang").agg(F.count("*").alias("_n"), F.sum("edits").alias("edits"), F.sum("ref_len").alias("total"))
    told = lines.where("t = 'summary'").select("lang", "n", "cer", "error").join(made, "lang", "left")
    again = F.col("error").isNull() & F.col("_n").isNotNull()
    value = F.when(again, F.col("edits") / F.nullif(F.col("total"), F.lit(0).cast("long"))).otherwise(F.col("cer"))
    rates = told.select("lang", F.when(again, F.col("_n")).otherwise(F.col("n")).alias("n"), *[F.when(again, F.col(c)).alias(c) for c in ("edits", "total")], value.alias("cer"), "error")
    ended = F.col("t") == "end"
    totals = lines.agg(F.coalesce(F.max(F.when(ended, F.col("usd"))), F.sum(F.when(F.col("t") == "asr", F.col("usd"))), F.lit(0.0)).alias("usd"), F.coalesce(F.bool_or(ended), F.lit(False)).alias("complete"))
    return rates, totals


def joined_by_name(left: DataFrame, right: DataFrame, name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """left rows with their right row (of repeated names the last), and the left rows without one."""
    last = Window.partitionBy(name).orderBy(F.desc(order))
    unique = right.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", order)
    return left.join(unique, name), left.join(unique, name, "left_anti")


def sample_estimate(rows: DataFrame, by: str, seconds: str, scoreable: Column, n: int, usd_per_minute: Column) -> DataFrame:
    """by, clips, seconds, exact, usd, unscoreable of a sample of n clips of each group.

    Clips and durations are those of rows that can be scored: all of them when no more than n are there (exact), else n
    times their mean. Unscoreable is how many of the clips are expected to lack a reference, as records without one are
    drawn too. A null price gives a null usd.
    """
    good = F.coalesce(scoreable, F.lit(False))
    out = rows.groupBy(by).agg(F.count_if(good).alias("have"), F.coalesce(F.sum(F.when(good, F.col(seconds))), F.lit(0.0)).alias("all"), F.count_if(~good).alias("dropped"), F.min(usd_per_minute).alias("price"))
    clips, exact = F.least(F.col("have"), F.lit(n)), F.col("have") <= n
    length = F.when(exact, F.col("all")).otherwise(F.col("all") / F.col("have") * clips)
    return out.select(by, clips.alias("clips"), length.alias("seconds"), exact.alias("exact"), (length / 60 * F.col("price")).alias("usd"), (clips * F.col("dropped") / (F.col("have") + F.col("dropped"))).alias("unscoreable"))


def dry_run_totals(estimates: DataFrame) -> DataFrame:
    """One row: clips, seconds and usd of all estimates, projected if one is, unpriced if one has no price (usd is then of the others)."""
    return estimates.agg(F.coalesce(F.sum("clips"), F.lit(0)).alias("clips"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"),
                         F.coalesce(F.bool_or(~F.col("exact")), F.lit(False)).alias("projected"), F.coalesce(F.bool_or(F.col("usd").isNull()), F.lit(False)).alias("unpriced"))


#: Fixed value: share of letters from which a run counts as in its script.
IN_SCRIPT = 0.9


def stability(rows: DataFrame, by: str, text: Column, in_script: Column, speakers: Column | None = None) -> DataFrame:
    """by, runs, in_script, distinct_texts, and with speakers (heard in a run) multi_speaker. in_script is a condition, or the share of letters, which counts from 0.9; a null share is 0."""
    share = rows.select(in_script.alias("x")).schema["x"].dataType.typeName() != "boolean"
    inside = F.coalesce(in_script.cast("double"), F.lit(0.0)) >= IN_SCRIPT if share else in_script
    more = [] if speakers is None else [F.count_if(speakers > 1).alias("multi_speaker")]
    return rows.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(inside).alias("in_script"), F.countDistinct(text).alias("distinct_texts"), *more)


def reviews(rows: DataFrame, signed: DataFrame, code: str = "code", run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """rows with reviewed: a passing sign-off counts only for the run that it names; and the stale sign-offs, of known codes but other runs."""
    passed = signed.where("verdict = 'pass'").select(code, run).distinct()
    known = rows.select(code, run).distinct()
    out = rows.join(passed.withColumn("reviewed", F.lit(True)), [code, run], "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
    return out, passed.join(known.select(code).distinct(), code, "left_semi").join(known, [code, run], "left_anti")


#: Timing qualities, least first (fixed values).
TIMING = ["none", "partial", "full"]


def timing_quality(segments: DataFrame, by: Sequence[str], has_words: Column) -> DataFrame:
    """by, quality: full if all segments have words, none if no one has, else partial."""
    return segments.groupBy(*by).agg(F.when(F.bool_and(has_words), "full").when(F.bool_or(has_words), "partial").otherwise("none").alias("quality"))


def least_quality(rows: DataFrame, by: Sequence[str], quality: str = "quality") -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, TIMING)), F.col(quality))
    return rows.groupBy(*by).agg(F.min_by(quality, order).alias(quality))


def operation_state(body: Column, expected_uri: Column) -> Column:
    """State of a long-running operation from its JSON: running, succeeded, or failed with what is wrong. It has succeeded only if the file's own result has an address and no error."""
    b = F.from_json(body, "done boolean, error struct<code:int,message:string>, response struct<results:map<string,struct<uri:string,error:struct<code:int,message:string>>>>")
    file = F.try_element_at(b["response"]["results"], expected_uri)
    return (F.when(F.try_parse_json(body).isNull(), "unreadable").when(~F.coalesce(b["done"], F.lit(False)), "running").when(b["error"].isNotNull(), "failed: operation").when(file["error"].isNotNull(), "failed: file")
            .when(F.coalesce(file["uri"], F.lit("")) != "", "succeeded").otherwise("failed: no result"))


def dead_steps(steps: DataFrame, at: str, order: Sequence[str]) -> DataFrame:
    """Dead steps, the newest first, those without a time last."""
    return steps.where("state = 'dead'").orderBy(F.desc_nulls_last(at), *order)


#: Scripts written without spaces between words, and those whose lines break by dictionary or by character.
UNSPACED, ICU_BREAKS, CHARACTER_BREAKS = ("Mymr", "Khmr", "Thai", "Laoo", "Jpan", "Hani"), ("Thai", "Laoo", "Khmr"), ("Mymr", "Jpan", "Hani")


def text_rules(rows: DataFrame, script: str = "script") -> DataFrame:
    """rows with the text and subtitle rules of their script."""
    s = F.col(script)
    unspaced = s.isin(*UNSPACED)
    return rows.withColumns({
        "segmentation": F.when(unspaced, "none").otherwise("spaces"), "joiner": F.when(unspaced & (s != "Mymr"), "").otherwise(" "), "rates_strip_space": unspaced, "report_wer": ~unspaced,
        "chars_per_second": F.when(unspaced, 12).otherwise(17), "chars_per_line": F.when(unspaced, 24).otherwise(42), "max_lines": F.lit(2),
        "line_break": F.when(s.isin(*ICU_BREAKS), "icu").when(s.isin(*CHARACTER_BREAKS), "grapheme").otherwise("space")})


def provider_listing(capabilities: DataFrame, ranking: Sequence[str], word_confidence: dict[str, str] | None = None) -> DataFrame:
    """code, place, provider, model, status, word_timing, word_confidence: what each provider can do for a language, by rank.

    capabilities: code, provider, supported, status, verdict, probed_at, models, word_timing. The model is the first of
    a supported one. word_confidence says of a provider yes or no; of others it is unknown.
    """
    rank = F.array_position(F.array(*map(F.lit, ranking)), F.col("provider"))
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.when(rank > 0, rank).otherwise(len(ranking) + 1), "provider"))
    dated = lambda label: F.concat(F.lit(f"{label} ("), F.coalesce("probed_at", F.lit("never")), F.lit(")"))
    refused = F.when(F.col("status") == "accepted", dated("unsupported - accepted but mangles")).otherwise("unsupported - code not accepted")
    label = F.when(~F.coalesce("supported", F.lit(False)), refused).when(F.col("verdict") == "suspected", "accepted - quality unverified").when(F.col("verdict") == "measured-ok", "measured working").otherwise(dated("accepted - quality unmeasured"))
    sure = F.lit("unknown")
    for name, value in (word_confidence or {}).items():
        sure = F.when(F.col("provider") == name, value).otherwise(sure)
    return capabilities.select("code", place.alias("place"), "provider", F.when(F.col("supported"), F.get("models", F.lit(0))).alias("model"), label.alias("status"), "word_timing", sure.alias("word_confidence"))


def probe_summary(attempts: DataFrame, by: str = "provider") -> DataFrame:
    """by, codes, accepted, rejected, errored, unknown: codes tried, and how many had each outcome as their best."""
    order = F.array(*map(F.lit, ("accepted", "error", "unknown", "rejected")))
    best = attempts.groupBy(by, "code").agg(F.min_by("outcome", F.array_position(order, F.col("outcome"))).alias("o"))
    return best.groupBy(by).agg(F.count("*").alias("codes"), *[F.count_if(F.col("o") == x).alias(n) for x, n in (("accepted", "accepted"), ("rejected", "rejected"), ("error", "errored"), ("unknown", "unknown"))])
