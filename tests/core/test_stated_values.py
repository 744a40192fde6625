"""Values worked out by hand for operators whose SQL follows the same rule as the code."""

import pytest
from pyspark.sql import functions as F

from speechlake.functions import text as T
from speechlake.operators import assembly as A
from speechlake.operators import evaluation as E
from speechlake.operators import operations as O
from speechlake.operators import registry as R
from speechlake.operators import speakers as S
from speechlake.sources import files


def test_orders_that_a_reference_lacks_count_no_hypothesis(spark):
    df = spark.createDataFrame([("abcdefgh", "ab"), ("hello there", "hello there")], "given string, ref string").withColumn("g", F.lit(1))
    assert round(E.corpus_chrf(df, ["g"], hyp="given").first().chrf, 2) == 97.39
    same = spark.createDataFrame([("abc", "abc"), ("", "abc"), ("zzz", "")], "given string, ref string").withColumn("g", F.monotonically_increasing_id())
    assert sorted(round(r.chrf, 6) for r in E.corpus_chrf(same, ["g"], hyp="given").collect()) == [0.0, 0.0, 100.0]


def test_what_fits_a_request_is_not_cut(spark):
    cases = {1: (28_000, [20_000]), 2: (27_000, [20_000]), 3: (28_001, [20_000]), 4: (28_001, []), 5: (60_000, [13_999, 14_000, 27_000, 41_500, 55_000]), 6: (28_000, [])}
    assets = spark.createDataFrame([(i, d) for i, (d, _) in cases.items()], "asset_id long, duration_ms long")
    silences = spark.createDataFrame([(i, s) for i, (_, ss) in cases.items() for s in ss], "asset_id long, at_ms long")
    got = {}
    for r in A.chunk_plan(assets, silences, 30_000, 2_000).orderBy("asset_id", "idx").collect():
        got.setdefault(r.asset_id, []).append((r.offset_ms, r.content_start_ms, r.end_ms))
    assert got == {1: [(0, 0, 28_000)], 2: [(0, 0, 27_000)], 3: [(0, 0, 20_000), (18_000, 20_000, 28_001)], 4: [(0, 0, 28_000)],  # the last millisecond is too short to ask for
                   5: [(0, 0, 27_000), (25_000, 27_000, 55_000), (53_000, 55_000, 60_000)], 6: [(0, 0, 28_000)]}


def test_call_outcomes(spark):
    cases = [(200, None, "accepted"), (299, "not supported", "accepted"), (400, "Model not supported", "rejected"), (400, "Invalid language", "rejected"), (400, "bad language code", "rejected"), (400, "Unsupported language: xx\nLanguage must be one of", "rejected"),
             (400, "the language is invalid", "rejected"), (400, "Language code 'ha' is not recognized.", "rejected"), (400, "bad audio", "error"), (400, None, "error"), (429, "not supported", "unknown"), (500, None, "unknown")]
    df = spark.createDataFrame(cases, "s int, b string, want string")
    assert [tuple(r) for r in df.withColumn("got", R.call_outcome(F.col("s"), F.col("b"))).where("got <> want").collect()] == []


def test_roll_up_learns_only_from_acceptance_and_plain_refusal(spark):
    attempts = [("a", "m1", "rejected", None), ("a", "m2", "accepted", False), ("a", "m3", "accepted", None), ("b", "m1", "accepted", False), ("b", "m2", "accepted", True), ("c", "m1", "rejected", None), ("d", "m1", "rejected", None), ("d", "m2", "error", None), ("e", "m1", "unknown", None), ("f", "m1", "unknown", None), ("f", "m2", "error", None), ("h", "m1", "accepted", None)]
    before = [("c", "accepted", True, ["x"], True), ("d", "accepted", True, ["x"], True), ("f", "rejected", False, None, None), ("g", "accepted", True, ["x"], False)]
    a = spark.createDataFrame(attempts, "code string, model string, outcome string, word_timing boolean")
    p = spark.createDataFrame(before, "code string, status string, supported boolean, models array<string>, word_timing boolean")
    assert {r.code: tuple(r)[1:] for r in R.capability_roll_up(a, p).collect()} == {
        "a": ("accepted", True, ["m2", "m3"], False), "b": ("accepted", True, ["m1", "m2"], True), "c": ("rejected", False, [], None), "d": ("error", True, ["x"], True), "e": ("unknown", False, [], None),
        "f": ("error", False, [], None), "g": ("accepted", True, ["x"], False), "h": ("accepted", True, ["m1"], None)}
    summary = R.probe_summary(a.withColumn("provider", F.lit("p"))).first()
    assert (summary.codes, summary.accepted, summary.rejected, summary.errored, summary.unknown) == (7, 3, 1, 2, 1)


def test_progress_within_bounds(spark):
    rows = [(1, "awaiting_external", 0.0), (2, "awaiting_external", 0.6), (3, "running", 7.0), (4, "running", float("nan")), (5, "running", float("inf")), (6, "running", -3.0), (7, "awaiting", 0.9), (8, "dead", None), (9, "running", None), (10, "ready", 0.9)]
    df = spark.createDataFrame([(r, "k", 0, 4, s, False, 0, p) for r, s, p in rows], "run_id long, kind string, shard int, weight int, state string, optional boolean, attempt int, progress double")
    assert {r.run_id: r.progress for r in O.run_progress(df).collect()} == {1: 0.1, 2: 0.6, 3: 1.0, 4: 0.1, 5: 0.1, 6: 0.1, 7: 0.0, 8: 1.0, 9: 0.1, 10: 0.0}


def test_operations_need_an_address(spark):
    cases = [('{"done":true,"response":{"results":{"u":{}}}}', "failed: no result"), ('{"done":true,"response":{"results":{"u":{"uri":""}}}}', "failed: no result"), ('{"done":true,"response":{"results":{"u":{"uri":"o"}}}}', "succeeded"),
             ('{"done":true,"response":{"results":{"u":{"uri":"o","error":{"code":13}}}}}', "failed: file"), ('{"done":true,"error":{}}', "failed: operation"), ('{"metadata":{}}', "running"), ('{"done":true}', "failed: no result"), ("torn", "unreadable")]
    df = spark.createDataFrame(cases, "b string, want string").withColumn("got", R.operation_state(F.col("b"), F.lit("u")))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []


LINES = "t string, lang string, edits long, ref_len long, usd double, n long, cer double, error string"


def test_replay(spark):
    lines = [("run", None, None, None, None, None, None, None), ("asr", "en", None, None, 0.5, None, None, None), ("asr", "de", None, None, 0.25, None, None, None), ("score", "en", 1, 10, 9.0, None, None, None), ("score", "en", 3, 10, 9.0, None, None, None), ("score", "de", 9, 10, 9.0, None, None, None),
             ("summary", "en", None, None, None, 7, 0.9, None), ("summary", "de", None, None, None, 7, None, "budget"), ("summary", "fr", None, None, None, 4, 0.3, None)]
    rates, totals = R.replayed(spark.createDataFrame(lines, LINES))
    assert {r.lang: (r.n, r.edits, r.total, r.cer, r.error) for r in rates.collect()} == {"en": (2, 4, 20, 0.2, None), "de": (7, None, None, None, "budget"), "fr": (4, None, None, 0.3, None)}
    assert tuple(totals.first()) == (0.75, False)
    _, totals = R.replayed(spark.createDataFrame([*lines, ("end", None, None, None, 3.0, None, None, None)], LINES))
    assert tuple(totals.first()) == (3.0, True)


def test_estimates_are_of_rows_that_can_be_scored(spark):
    rows = [("a", 10.0, True)] * 3 + [("a", 99.0, False)] + [("b", 6.0, True), ("b", 12.0, True)] * 3 + [("b", 50.0, False)] * 2 + [("c", 5.0, False)]
    df = spark.createDataFrame(rows, "lang string, s double, ok boolean")
    got = R.sample_estimate(df, "lang", "s", F.col("ok"), 4, F.when(F.col("lang") != "c", 0.06))
    assert {r.lang: (r.clips, r.seconds, r.exact, None if r.usd is None else round(r.usd, 9), r.unscoreable) for r in got.collect()} == {"a": (3, 30.0, True, 0.03, 0.75), "b": (4, 36.0, False, 0.036, 1.0), "c": (0, 0.0, True, None, 0.0)}
    total = R.dry_run_totals(got).first()
    assert (total.clips, total.seconds, round(total.usd, 9), total.projected, total.unpriced) == (7, 66.0, 0.066, True, True)


def test_durations_and_keys(spark):
    cases = [(0.0, "—"), (-5.0, "—"), (0.4, "0m 00s"), (30.0, "0m 30s"), (59.6, "1m 00s"), (582.0, "9m 42s"), (3700.0, "61m 40s"), (119.5, "2m 00s")]
    df = spark.createDataFrame(cases, "s double, want string").withColumn("got", T.human_duration(F.col("s")))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []
    have = spark.createDataFrame([(2, "speaker-03"), (2, "guest"), (3, "guest")], "run_id long, speaker_key string")
    fresh = spark.createDataFrame([(1, "x", 50), (1, "y", 10), (2, "x", 0), (3, "a", 5), (3, "b", 5)], "run_id long, fresh_key string, first_ms long")
    assert {(r.run_id, r.fresh_key): r.speaker_key for r in S.allocate_keys(have, fresh).collect()} == {(1, "y"): "speaker-00", (1, "x"): "speaker-01", (2, "x"): "speaker-04", (3, "a"): "speaker-00", (3, "b"): "speaker-01"}


def test_reports(spark):
    rows = spark.createDataFrame([("a", "verified", "measured", [], 1.0), ("b", "beta", "measured", ["n<30"], None), ("c", "beta", "measured", ["n<30", "humanReview"], 1.4), ("d", "unsupported", "code-rejected", ["code-rejected"], 1.0), ("e", "experimental", "not-run", ["not-run"], None)], "lang string, tier string, reason string, blocked array<string>, ratio double")
    assert {tuple(r) for r in E.blocked_queue(rows).collect()} == {("b", "n<30", True), ("c", "n<30", False), ("c", "humanReview", False)}
    assert [r.lang for r in E.report_rows(rows).orderBy("place").collect()] == ["a", "c", "b", "e", "d"]
    stats = spark.createDataFrame([("a", i, e, n) for i, (e, n) in enumerate([(2, 2), (5, 100), (0, 9), (5, 50), (4, 4)])], "arm string, id int, edits_c int, len_c int")
    assert [(r.place, r.id) for r in E.rewritten_examples(stats, ["arm"], ["id"]).orderBy("place").collect()] == [(1, 1), (2, 3)]


def test_the_lenient_reader(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('7\tf\tone\ttwo\tg\t160\tMALE\nx9\tf\t"a ""b"""\ttwo\tg\t12.5s\tMALE\nshort\tf\n8\tf\tone\ttwo\tg\tnone\tFEMALE\n')
    rows = {r.id: (r.plain, r.raw, r.num_samples) for r in files.read_eval_rows_lenient(spark, f"file://{tmp_path}").collect()}
    assert rows == {"7": ("one", "two", 160), "x9": ('a "b"', "two", 12), "8": ("one", "two", 0)}
    good, dropped = files.read_eval_rows(spark, f"file://{tmp_path}")
    assert sorted(r.id for r in good.collect()) == [7, 8] and dropped.first().dropped == 2


def test_recognised_segments(spark):
    body = """[{"alternatives":[{"transcript":" one two ","confidence":0.5,"words":[{"word":"one","startOffset":"1s","endOffset":"1.5s"},{"word":""},{"word":"two"},{"word":"x","startOffset":"1.7s"}]}]},
      {"alternatives":[{"transcript":"no words"}],"resultEndOffset":"4s"}, {"alternatives":[{"transcript":"  "}],"resultEndOffset":"9s"}, {"alternatives":[{"transcript":"back"}],"resultEndOffset":"3s"}, {"alternatives":[{"transcript":"open","words":[{"word":"a"}]}]},
      {"alternatives":[{"transcript":"again","words":[{"word":"b","startOffset":"2s","endOffset":"2.5s"}]}]}, {"alternatives":[{"transcript":"end"}],"resultEndOffset":"6s"}, {"resultEndOffset":"8s"}]"""
    df = spark.createDataFrame([(1, body), (2, '[{"alternatives":[{"transcript":"x"}]}]'), (3, "torn")], "k long, body string")
    got = A.recognised_segments(df, ["k"], "body", F.lit(1000).cast("long"), F.lit(5000).cast("long"))
    assert [(r.text, r.start_ms, r.end_ms, len(r.words), r.timed, r.bounded) for r in got.where("k = 1").orderBy("idx").collect()] == [
        ("one two", 2000, 2700, 3, True, True), ("no words", 2700, 5000, 0, False, True), ("back", 5000, 5000, 0, False, True), ("open", 5000, 6000, 0, False, False), ("again", 3000, 3500, 1, True, True), ("end", 3500, 7000, 0, False, True)]
    assert [(r.k, r.start_ms, r.end_ms) for r in got.where("k <> 1").collect()] == [(2, 1000, 6000)]
    words = A.recognised_words(df, ["k"], "body", F.lit(1000).cast("long")).orderBy("result", "word_idx").collect()
    assert [(w.text, w.start_ms, w.end_ms) for w in words] == [("one", 2000, 2500), ("two", 1000, 1000), ("x", 2700, 2700), ("b", 3000, 3500)]


def test_equal_ranks_and_empty_tables(spark):
    assert O.run_progress(spark.createDataFrame([], "run_id long, kind string, shard int, weight int, state string, optional boolean, attempt int, progress double")).collect() == []
    total = R.dry_run_totals(spark.createDataFrame([], "lang string, clips long, seconds double, exact boolean, usd double, unscoreable double")).first()
    assert (total.clips, total.seconds, total.usd, total.projected, total.unpriced) == (0, 0.0, 0.0, False, False)
    with pytest.raises(Exception):
        S.merge_speakers(spark.createDataFrame([(1, "a")], "run_id long, speaker_key string"), spark.createDataFrame([(1, "a", "a")], "run_id long, from_key string, into_key string")).collect()


def test_segments_are_rebuilt_after_a_seam(spark):
    words = lambda *ws: [(w, 100 * i, i) for i, w in ws]
    segs = [(1, 1, 0, "a b", "A B", 0, 200, words((1, "a"), (2, "b"))), (1, 1, 1, "no words", "NO", 200, 300, None), (1, 1, 2, "c d e", "C D E", 300, 500, words((3, "c"), (4, "d"), (5, "e"))), (1, 1, 3, "f", "F", 600, 700, words((6, "f"))), (1, 0, 0, "x", "X", 0, 9, words((0, "x"))), (2, 1, 0, "y", "Y", 0, 9, words((0, "y"))), (3, 1, 0, "z", "Z", 0, 9, [])]
    df = spark.createDataFrame(segs, "run_id long, chunk long, idx int, text string, text_raw string, start_ms long, end_ms long, words array<struct<text:string,start_ms:long,k:int>>")
    found = spark.createDataFrame([(1, 1, 3), (2, 1, 7), (3, 1, 4)], "run_id long, chunk long, drop_through long")
    got = {(r.run_id, r.chunk, r.idx): (r.text, r.text_raw, r.start_ms, None if r.words is None else [w.k for w in r.words]) for r in A.rebuilt_segments(df, found).collect()}
    assert got == {(1, 1, 0): ("no words", "NO", 200, None), (1, 1, 1): ("e", "C D E", 500, [5]), (1, 1, 2): ("f", "F", 600, [6]), (1, 0, 0): ("x", "X", 0, [0]), (3, 1, 0): ("z", "Z", 0, [])}
    joined = A.rebuilt_segments(df, spark.createDataFrame([(1, 1, 2)], "run_id long, chunk long, drop_through long"), joiner="").where("run_id = 1 and chunk = 1").orderBy("idx").collect()
    assert [r.text for r in joined] == ["no words", "de", "f"]


def test_items_say_why_they_have_no_price(spark):
    rows = [("o", 60_000, 0.5, "default"), ("o", None, 0.5, "default"), ("o", 30_000, None, None), ("o", None, None, None), ("o", 30_000, 1.0, "override"), ("p", None, 1.0, "override")]
    items = O.batch_items(spark.createDataFrame(rows, "o string, d long, usd_per_unit double, rate_source string"), F.col("d"))
    assert [(r.usd, r.unpriced_reason) for r in items.collect()] == [(0.5, None), (None, "unknown_duration"), (None, "no_rate"), (None, "unknown_duration"), (0.5, None), (None, "unknown_duration")]
    assert {tuple(r) for r in O.batch_estimate(items, ["o"]).collect()} == {("o", 5, 120_000, 1.0, 3, "mixed"), ("p", 1, 0, 0.0, 1, "none")}


def test_listing_labels(spark):
    caps = [("a", True, "accepted", "probe-only", "d", ["m", "n"]), ("b", True, "accepted", "suspected", "d", ["m"]), ("c", True, "accepted", "measured-ok", "d", None), ("d", False, "accepted", "measured-failure", "2026", ["m"]), ("e", False, "rejected", "measured-failure", "d", None), ("f", False, "unknown", "probe-only", None, None), ("g", True, "error", "probe-only", None, ["k"])]
    df = spark.createDataFrame([("x", *c, None) for c in caps], "code string, provider string, supported boolean, status string, verdict string, probed_at string, models array<string>, word_timing boolean")
    got = R.provider_listing(df, ["c", "a"], {"a": "no", "b": "yes"}).orderBy("place").collect()
    assert [(r.provider, r.model, r.status, r.word_confidence) for r in got] == [
        ("c", None, "measured working", "unknown"), ("a", "m", "accepted - quality unmeasured (d)", "no"), ("b", "m", "accepted - quality unverified", "yes"), ("d", None, "unsupported - accepted but mangles (2026)", "unknown"), ("e", None, "unsupported - code not accepted", "unknown"),
        ("f", None, "unsupported - code not accepted", "unknown"), ("g", "k", "accepted - quality unmeasured (never)", "unknown")]


def test_changes_say_why(spark):
    schema = "lang string, tier string, cer double, reason string, blocked array<string>"
    old = spark.createDataFrame([("a", "beta", 0.2, "measured", ["n<30"]), ("b", "beta", 0.2, "measured", []), ("c", "beta", 0.2, "measured", []), ("d", "beta", 0.3, "measured", []), ("e", "beta", 0.3, "measured", []), ("gone", "beta", 0.3, "measured", [])], schema)
    new = spark.createDataFrame([("a", "verified", 0.1, "measured", []), ("b", "unsupported", None, "script-integrity", ["x"]), ("c", "experimental", None, "no-eval-set", ["no-eval-set"]), ("d", "beta", 0.1, "measured", []), ("e", "experimental", 0.4, "measured", ["cer>0.2", "n<30"]), ("n", "beta", 0.2, "measured", ["n<30"])], schema)
    assert {r.lang: (r.before, r.after, r.cer_before, r.cer_after, r.why, r.change) for r in E.tier_changes(old, new).collect()} == {
        "a": ("beta", "verified", 0.2, 0.1, "cleared every verified gate", "promoted"), "b": ("beta", "unsupported", 0.2, None, "script integrity below the floor", "demoted"), "c": ("beta", "experimental", 0.2, None, "no eval set for this language", "demoted"),
        "e": ("beta", "experimental", 0.3, 0.4, "blocked by cer>0.2, n<30", "demoted"), "n": (None, "beta", None, 0.2, "first measurement — measured", "new")}


def test_arms_and_their_gate(spark):
    pairs = [("en", "control", "m", i, "Some words here.", "some words here", "some words here") for i in range(5)] + [("en", "edit", "m", i, "Some words here.", "UN some words here", h) for i, h in enumerate(["UN some words here", "some other thing", "Some words here."])]
    stats = E.cleanup_stats(spark.createDataFrame(pairs, "lang string, arm string, model string, id int, ref string, given string, hyp string"))
    failures = spark.createDataFrame([("en", "edit", "m", 2, "timeout"), ("fr", "edit", "m", 4, "rate limit")], "lang string, arm string, model string, failed long, failure string")
    arms = E.arm_results(stats, ["lang", "arm", "model"], ["id"], failures, b=100)
    got = {(r.lang, r.arm): r for r in arms.collect()}
    edit = got["en", "edit"]
    assert (edit.n, edit.failed, edit.failure, edit.entities_lost, [e.id for e in edit.examples]) == (3, 2, "timeout", ["UN"], [1, 2]) and edit.lo <= edit.cer_punct <= edit.hi
    assert (got["fr", "edit"].n, got["fr", "edit"].failed, got["fr", "edit"].cer_punct, got["fr", "edit"].examples) == (0, 4, None, []) and got["en", "control"].entities_lost == []
    languages = spark.createDataFrame([("en", None, True), ("fr", None, True), ("de", "no key", True), ("xx", None, False), ("yy", "broken", False)], "lang string, error string, has_set boolean")
    gate = E.cleanup_gate(arms, "control", ["control", "edit"], languages, ["m"]).collect()
    assert {(r.lang, r.failure, r.reason) for r in gate if r.value is None} == {("fr", "not_measured", "rate limit"), ("de", "not_measured", "no key"), ("yy", "not_measured", "broken")}
    worst = [r for r in gate if r.value is not None]
    assert {r.failure for r in worst} == {"cer_punct", "content_delta", "entity_drift"} and all(r.model == "m" and r.example.output == "some other thing" and r.entities_lost == ["UN"] for r in worst)
    assert [r.delta for r in worst] == sorted([r.delta for r in worst], reverse=True)
    two = E.cleanup_gate(arms.where("lang = 'en'"), "control", ["edit"], models=["m", "k"]).collect()
    assert [(r.failure, r.model, r.reason) for r in two] == [("not_measured", "m,k", "timeout")]


def test_a_caller_adds_a_statistic(spark):
    from speechlake.operators import statistics as C

    df = spark.createDataFrame([("a", "kitten", "sitting"), ("a", "x", "x"), ("a", None, "yy"), ("b", "one two", "one three")], "g string, hyp string, ref string")
    own = C.Statistic("empty", lambda h, r: {"n": F.lit(1), "empty": (h == "").cast("long")}, lambda s: s["empty"] / s["n"])
    longest = C.Statistic("longest", lambda h, r: {"most": F.length(h)}, lambda s: s["most"], {"most": F.max})
    got = {r.g: r for r in C.corpus(df, ["g"], ["cer", "wer", "chrf", own, longest]).collect()}
    assert (got["a"].cer, got["a"].wer, got["a"].empty, got["a"].longest) == (0.5, 2 / 3, 1 / 3, 6) and got["b"].wer == 0.5 and got["b"].empty == 0.0
    filled = df.fillna({"hyp": ""})
    assert {r.g: round(r.chrf, 9) for r in E.corpus_chrf(filled, ["g"]).collect()} == {g: round(r.chrf, 9) for g, r in got.items()}
    C.register(own)
    assert C.corpus(df, ["g"], ["empty"]).count() == 2
    for bad in (lambda: C.register(C.Statistic("cer", own.contribution, own.finish)), lambda: C.corpus(df, ["g"], ["cer", "cer"])):
        with pytest.raises(ValueError):
            bad()


def test_speech_between_two_frames_has_no_frames(spark):
    turns = "run_id long, speaker_key string, start_ms long, end_ms long"
    ref = spark.createDataFrame([(1, "a", 0, 300), (1, "b", 310, 370)], turns)
    hyp = spark.createDataFrame([(1, "x-a", 0, 300), (1, "x-b", 420, 480)], turns)
    names = spark.createDataFrame([(1, "x-a", "a"), (1, "x-b", "b")], "run_id long, fresh_key string, prior_key string")
    assert [tuple(r) for r in S.frame_error(ref, hyp, names, 100).select("frames", "miss", "confusion", "false_alarm").collect()] == [(3, 0, 0, 0)]
