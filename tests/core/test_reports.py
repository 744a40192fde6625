"""Alignment ties, report tables and registry tables, by hand-worked values and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from speechlake.functions import text as T
from speechlake.operators import assembly as A
from speechlake.operators import operations as O
from speechlake.operators import registry as R
from speechlake.operators import reports
from speechlake.operators import speakers as S


def walks(a, b, i=0, j=0):
    """All walks over two sequences as their moves; equal tokens must be matched (M), else a token of a (A) or of b (B) is skipped."""
    if i == len(a) or j == len(b):
        yield "", []
    elif a[i] == b[j]:
        for moves, pairs in walks(a, b, i + 1, j + 1):
            yield "M" + moves, [(i, j), *pairs]
    else:
        for moves, pairs in walks(a, b, i + 1, j):
            yield "A" + moves, pairs
        for moves, pairs in walks(a, b, i, j + 1):
            yield "B" + moves, pairs


def test_of_longest_alignments_the_one_that_skips_the_earlier_text_first():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in "ab")
        found = list(walks(a, b))
        most = max(len(p) for _, p in found)
        assert A.lcs_pairs(a, b) == min((m, p) for m, p in found if len(p) == most)[1], (a, b)
    assert A.lcs_pairs(list("daceeed"), list("beb")) == [(5, 1)]
    assert A.lcs_pairs(list("xyxz"), list("zx")) == [(3, 0)]


def test_sentences_meet_once_and_samples_keep_their_number(spark):
    source = spark.createDataFrame([("fr", 1, 10, "b"), ("fr", 1, 9, "a"), ("fr", 2, 11, "c"), ("fr", None, 12, "n"), ("de", 2, 13, "d"), ("de", 3, 14, "e"), ("es", 7, 15, "f")], "lang string, sid int, id int, given string")
    target = spark.createDataFrame([(1, 3, "A"), (2, 5, "Z"), (2, 4, "B"), (3, 6, "C"), (None, 8, "N")], "sid int, id int, ref string")
    out = reports.joined_sentences(source, target, "lang", ["sid"], ["id"])
    assert sorted((r.lang, r.sid, r.given, r.ref, r.joined) for r in out.collect()) == [("de", 2, "d", "B", 2), ("de", 3, "e", "C", 2), ("fr", 1, "a", "A", 2), ("fr", 2, "c", "B", 2)]
    one = reports.joined_sentences(source, target, "lang", ["sid"], ["id"], n=1).collect()
    assert sorted((r.lang, r.joined) for r in one) == [("de", 2), ("fr", 2)]
    assert reports.joined_sentences(source.limit(0), target, "lang", ["sid"], ["id"]).collect() == []
    with pytest.raises(ValueError):
        reports.joined_sentences(source.withColumn("clip", F.lit(1)), target.withColumn("clip", F.lit(1)), "lang", ["sid", "clip"], ["id"], n=1)


def test_translations_with_ceiling_and_bar_first(spark):
    scores = spark.createDataFrame([("en", "m", 72.0), ("my", "m", 41.5), ("ha", "m", 41.5), ("ha", "k", 50.0), ("yo", "m", 12.0), ("jv", "m", 60.0)], "lang string, model string, chrf double")
    counts = spark.createDataFrame([("en", 90, 30), ("my", 80, 30), ("ha", 70, 30), ("yo", 20, 20), ("jv", 5, 5)], "lang string, joined long, n long")
    errors = spark.createDataFrame([("jv", "not run: budget exhausted")], "lang string, error string")
    out = reports.translation_report(scores, counts, ["yo", "ha", "jv", "so"], "en", "my", ["m", "k"], errors).orderBy("place", F.desc("model")).collect()
    assert [(r.lang, r.role) for r in out if r.model == "m"] == [("en", "ceiling"), ("my", "bar"), ("yo", "measured"), ("ha", "measured"), ("jv", "measured"), ("so", "measured")]
    by = {(r.lang, r.model): r for r in out}
    assert all(r.ceiling == 72.0 and r.bar == 41.5 for r in out)
    assert by["ha", "m"].at_bar and by["ha", "k"].at_bar and not by["yo", "m"].at_bar and by["yo", "k"].chrf is None and by["yo", "k"].at_bar is None
    assert (by["jv", "m"].chrf, by["jv", "m"].n, by["jv", "m"].error) == (None, None, "not run: budget exhausted")
    assert (by["so", "m"].joined, by["so", "m"].error) == (None, None)
    bare = reports.translation_report(scores.limit(0), counts.limit(0), [], "en", "en", ["m"]).collect()
    assert [(r.lang, r.role, r.chrf, r.ceiling, r.bar) for r in bare] == [("en", "ceiling", None, None, None)]


def test_failures_examples_and_notes(spark):
    rows = spark.createDataFrame([("my", 0.02, 0.9), ("en", 1.0, 0.1), ("xx", None, None), ("zz", 0.5, None), ("ed", 0.8, 0.2)], "lang string, integrity double, cer double")
    clips = spark.createDataFrame([(1, "my", "r1", "h1", 1, 2), (2, "my", "r2", "h2", 3, 3), (3, "my", "r3", "h3", 2, 2), (4, "my", "", "h", 1, 0), (5, "en", "r", "h", 0, 4)], "id int, lang string, ref string, hyp string, edits long, ref_len long")
    worst = reports.worst_examples(clips, "lang", ["id"])
    assert {r.lang: (r.ref, r.hyp) for r in worst.collect()} == {"my": ("r2", "h2"), "en": ("r", "h")}
    assert sorted(tuple(r) for r in reports.integrity_failures(rows, worst).select("lang", "ref").collect()) == [("my", "r2"), ("zz", None)]
    described = spark.createDataFrame([("my", 30, {"FEMALE": 30}, 27, True), ("en", 5, {"MALE": 2, "FEMALE": 3}, 5, False), ("ha", 0, {}, 0, True)], "lang string, clips long, groups map<string,long>, distinct_ids long, uniform boolean")
    lost = spark.createDataFrame([("my", 2), ("yo", 3), ("en", 0)], "lang string, unmatched long")
    assert {r.lang: r.notes for r in reports.sample_notes(described, unmatched=lost).collect()} == {
        "my": "Every clip in this sample is FEMALE; the split cannot show speaker concentration. 30 clips cover 27 distinct sentences. 2 fetched clip(s) had no reference text and were dropped.", "yo": "3 fetched clip(s) had no reference text and were dropped."}
    assert {r.lang for r in reports.sample_notes(described).collect()} == {"my"}


def test_languages_resolve_and_filter(spark):
    entries = spark.createDataFrame([("my", "Mymr"), ("ha", "Latn"), ("yo", "Latn")], "code string, script string")
    seed = spark.createDataFrame([("my", "verified", True, True, "in use"), ("ha", "beta", False, False, None)], "code string, tier string, enabled boolean, human_reviewed boolean, notes string")
    measured = spark.createDataFrame([("my", "beta", 0.07, 1.0, 100, False, "all FEMALE")], "code string, tier string, cer double, cer_ratio double, n long, human_reviewed boolean, notes string")
    override = spark.createDataFrame([("ha", "unsupported", True, None), ("qq", "beta", True, "x")], "code string, tier string, enabled boolean, notes string")
    out = R.resolved_languages(entries, seed, measured, override)
    assert {r.code: (r.tier, r.tier_source, r.enabled, r.cer, r.n, r.human_reviewed, r.notes) for r in out.collect()} == {
        "my": ("beta", "measured", True, 0.07, 100, False, "all FEMALE in use"), "ha": ("unsupported", "override", True, None, None, False, None), "yo": (None, None, None, None, None, None, None)}
    caps = spark.createDataFrame([("my", "g", True), ("my", "o", False), ("ha", "g", True), ("ha", "o", True), ("yo", "o", True)], "code string, provider string, accepted boolean")
    codes = lambda **f: sorted(r.code for r in R.filtered_languages(out, caps, **f).collect())
    assert codes() == ["ha", "my", "yo"] and codes(tiers=["beta"]) == ["my"] and codes(enabled=True) == ["ha", "my"] and codes(script="Latn") == ["ha", "yo"]
    assert codes(provider="g") == ["ha", "my"] and codes(not_by="g") == ["yo"] and codes(exclusive_to="g") == ["my"] and codes(provider="o", enabled=True) == ["ha"]


def test_profiles_score_as_the_form_with_the_same_settings(spark):
    languages = spark.createDataFrame([("my", "Mymr", "none", False, True), ("en", "Latn", "spaces", False, False), ("qq", "None", "spaces", False, False)], "code string, script string, segmentation string, legacy_encoding boolean, strip_space boolean")
    digits = "၀၁၂၃၄၅၆၇၈၉"
    scripts = spark.createDataFrame([("Mymr", True, False, digits), ("Latn", True, True, "12")], "script string, zwnj boolean, zwj boolean, native_digits string")
    profiles = R.scoring_profiles(languages, scripts)
    assert sorted((r.code, r.letterlike) for r in profiles.collect()) == [("en", []), ("my", [])]
    rows = spark.createDataFrame([("my", "က၁၂ ခ‌၊ ဂ‍"), ("en", " Hi,‍  THE‌re 12 "), ("en", None), ("qq", "x")], "code string, text string").join(profiles, "code", "left")
    c = F.col("text")
    whole = F.when(F.col("code") == "my", T.scoring_form(c, digit_sets=[digits], zwnj=True, strip_space=True)).when(F.col("code") == "en", T.scoring_form(c, zwnj=True, zwj=True))
    got = rows.select("code", T.profiled_form(c, F.col("strip_space"), F.col("zwnj"), F.col("zwj"), F.col("native_digits")).alias("form"), whole.alias("want")).collect()
    assert all(r.form == r.want for r in got) and {r.form for r in got if r.code == "en"} == {None, "hi there 12"} and {r.form for r in got if r.code == "qq"} == {None}


def test_units_of_a_segment(spark):
    rows = spark.createDataFrame([(1, 0, 1000, " a\tbb\n c "), (2, 0, 900, ""), (3, 100, 100, "x y"), (4, 0, 90, "é b")], "id int, start_ms long, end_ms long, text string")
    words = A.interpolated_words(rows, ["id"]).collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in sorted(words, key=lambda r: (r.id, r.word_idx)) if r.id == 1] == [("a", 0, 250), ("bb", 250, 750), ("c", 750, 1000)]
    assert {r.id for r in words} == {1, 3, 4} and all(r.start_ms == r.end_ms == 100 for r in words if r.id == 3)
    marks = A.interpolated_words(rows.where("id = 4"), ["id"], "none").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in sorted(marks, key=lambda r: r.word_idx)] == [("é", 0, 60), ("b", 60, 90)]


def test_live_assets_unmatched_speakers_stability_and_nested_merges(spark):
    assets = spark.createDataFrame([("h1", 1, None), ("h2", 2, "2026-01-01"), ("h2", 3, None), ("h3", 4, "2026-01-01")], "sha256 string, asset_id int, deleted_at string")
    wanted = spark.createDataFrame([("h1",), ("h2",), ("h3",), ("h4",), (None,)], "sha256 string")
    assert sorted((str(r.sha256), r.asset and r.asset.asset_id) for r in O.assets_by_digest(wanted, assets).collect()) == [("None", None), ("h1", 1), ("h2", 3), ("h3", None), ("h4", None)]

    turns = "run_id long, speaker_key string, start_ms long, end_ms long"
    prior = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 10, 20), (2, "a", 0, 5)], turns)
    fresh = spark.createDataFrame([(1, "x", 5, 9), (1, "x", 1, 2), (1, "y", 3, 4)], turns)
    matches = spark.createDataFrame([(1, "x", "a")], "run_id long, fresh_key string, prior_key string")
    gone, new = S.unmatched_speakers(matches, prior, fresh)
    assert sorted(tuple(r) for r in gone.collect()) == [(1, "b"), (2, "a")] and [tuple(r) for r in new.collect()] == [(1, "y", 3)]

    runs = spark.createDataFrame([("mya", "t", 0.9, 1), ("mya", "t", 0.89, 2), ("mya", "u", None, 0), ("mya", None, 1.0, None)], "lang string, text string, share double, speakers int")
    assert tuple(R.stability(runs, "lang", F.col("text"), F.col("share"), F.col("speakers")).collect()[0]) == ("mya", 4, 2, 2, 1)

    docs = spark.createDataFrame([('{"a":1,"batch":{"x":1,"y":2}}', '{"y":3}'), ('{"a":1}', '{"y":3}'), (None, '{"y":3}'), ('{"batch":{"x":1}}', None)], "doc string, patch string")
    got = [r.m for r in docs.select(T.merge_json_at(F.col("doc"), "batch", F.col("patch")).alias("m")).collect()]
    assert [(m.get("a"), m["batch"]) for m in got] == [("1", '{"x":"1","y":"3"}'), ("1", '{"y":"3"}'), (None, '{"y":"3"}'), (None, '{"x":"1"}')]
