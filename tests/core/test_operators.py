"""Operators whose queries have no SQL, and edge cases of the others."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.functions import text as T
from speechlake.operators import assembly as A
from speechlake.operators import evaluation as E
from speechlake.operators import intervals as I
from speechlake.operators import operations as O
from speechlake.operators import speakers as S
from speechlake.sources import files

TURN = "run_id long, speaker_key string, start_ms long, end_ms long, idx long"


def test_assignment_is_the_best_of_all():
    rng = random.Random(3)
    for n in range(1, 7):
        for _ in range(15):
            cost = [[float(rng.randint(-5, 5)) for _ in range(n)] for _ in range(n)]
            got = S.assignment(cost)
            assert sorted(got) == list(range(n))
            assert sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert got == S.assignment(cost)


def test_range_join_meets_each_pair_once(spark):
    rng = random.Random(4)
    spans = lambda n: [(rng.randint(0, 2), i, s := rng.randint(0, 300), s + rng.choice([0, 5, 90])) for i in range(n)]
    a, b = spans(40), spans(40)
    left, right = (spark.createDataFrame(x, f"k int, {c} int, {c}s int, {c}e int") for x, c in ((a, "a"), (b, "b")))
    got = I.range_join(left, right, ["k"], (F.col("as"), F.col("ae")), (F.col("bs"), F.col("be")), bucket=50).select("a", "b").collect()
    want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_speakers_are_matched_one_to_one(spark):
    prior = spark.createDataFrame([(1, "A", 0, 10_000, 0), (1, "B", 10_000, 20_000, 1), (1, "C", 30_000, 30_500, 2)], TURN)
    fresh = spark.createDataFrame([(1, "x", 100, 9_000, 0), (1, "y", 9_000, 19_000, 1), (1, "z", 30_400, 40_000, 2)], TURN)
    got = {(r.fresh_key, r.prior_key, r.overlap_ms) for r in S.match_speakers(prior, fresh).collect()}
    assert got == {("x", "A", 8900), ("y", "B", 9000)}
    perfect = S.diarization_error(prior, prior).first()
    assert (perfect.der, perfect.miss, perfect.false_alarm, perfect.confusion) == (0.0, 0, 0, 0)
    swapped = prior.withColumn("speaker_key", F.lit("A"))
    assert S.diarization_error(prior, swapped).first().confusion == 10_500


def test_ties_and_gaps_of_words(spark):
    turns = spark.createDataFrame([(1, "A", 0, 100, 0), (1, "B", 50, 100, 1), (1, "B", 60, 110, 2), (1, "C", 1200, 1300, 3)], TURN)
    words = spark.createDataFrame([(1, 0, 0, 0, 40), (1, 0, 1, 50, 100), (1, 0, 2, 400, 500), (1, 0, 3, 800, 800), (1, 0, 4, 5000, 5100), (1, 0, 5, 1100, 1200)], "run_id long, idx long, word_idx int, start_ms long, end_ms long")
    got = {r.word_idx: (r.speaker_key, round(r.margin, 3), r.source) for r in S.assign_words(words, turns).collect()}
    assert got[0] == ("A", 1.0, "overlap") and got[1] == ("B", round(40 / 140, 3), "overlap")  # B's turns add up to 90, past A's 50
    assert got[2] == ("B", 0.0, "nearest") and got[3] == ("C", 0.0, "nearest") and got[4] == (None, 0.0, "none") and got[5][0] == "C"


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_chains_are_longest_common_subsequences():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in "ab")
        pairs = A.lcs_pairs(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert A.lcs_pairs(list("abcd"), list("xbxd")) == [(1, 1), (3, 3)] and A.lcs_pairs([], ["a"]) == []
    assert A.lcs_pairs(list("ab"), list("ba")) == [(1, 0)]


WORDS = "run_id long, chunk long, word_idx int, text string, start_ms long, end_ms long"
CHUNKS = "run_id long, chunk long, end_ms long, failed boolean"


def test_seams(spark):
    say = lambda c, words, at: [(1, c, i, w, at + 400 * i, at + 400 * i + 300) for i, w in enumerate(words)]
    rows = say(0, "a b c d E, f g h".split(), 0) + say(1, "e f g h i j".split(), 1600) + say(2, "p q r s".split(), 2800) + say(4, "late words here".split(), 9000) + say(5, "x y".split(), 30_000)
    words = spark.createDataFrame(rows, WORDS)
    chunks = spark.createDataFrame([(1, 0, 3200, False), (1, 1, 4400, False), (1, 2, 7000, False), (1, 3, 9000, True), (1, 4, 12_000, False), (1, 5, 40_000, False)], CHUNKS)
    found = {r.chunk: r for r in A.seams(words, chunks, 1600).collect()}
    assert set(found) == {1, 2, 5}  # none beside the failed chunk
    # e to h match, i ends just within the slack; h's middle, 2950, is nearest the seam at 3200
    assert (found[1].method, found[1].score, found[1].flagged, found[1].keep_through, found[1].drop_through) == ("lcs", 8 / 9, False, 7, 3)
    # nothing matches: the earlier chunk ends, and the later begins, at 4400 - 800
    assert (found[2].method, found[2].flagged, found[2].keep_through, found[2].drop_through) == ("hard-cut", True, 4, 2)
    assert (found[5].method, found[5].score, found[5].keep_through, found[5].drop_through) == ("empty", 1.0, 2, -1)
    out = [r.text for r in A.apply_seams(words, A.seams(words, chunks, 1600), trim_tail=True).orderBy("idx").collect()]
    assert out == "a b c d E, f g h i s late words here x y".split()


def test_seams_cut_the_earlier_tail_and_work_by_graphemes(spark):
    # the recogniser heard one more, wrong word at the end of chunk 0; the seam lies before it
    rows = [(1, 0, i, w, 500 * i, 500 * i + 400) for i, w in enumerate("a b c d zz".split())] + [(1, 1, i, w, 1000 + 500 * i, 1400 + 500 * i) for i, w in enumerate("c d e".split())]
    chunks = spark.createDataFrame([(1, 0, 2000, False), (1, 1, 4000, False)], CHUNKS)
    words = spark.createDataFrame(rows, WORDS)
    (r,) = A.seams(words, chunks, 1000).collect()
    assert (r.method, r.keep_through, r.drop_through) == ("lcs", 3, 1)
    assert [x.text for x in A.apply_seams(words, A.seams(words, chunks, 1000), trim_tail=True).orderBy("idx").collect()] == list("abcde")
    assert [x.text for x in A.apply_seams(words, A.seams(words, chunks, 1000)).orderBy("idx").collect()] == ["a", "b", "c", "d", "zz", "e"]
    (g,) = A.seams(words, chunks, 1000, segmentation="none").collect()
    assert g.method == "lcs" and g.score == 2 * 2 / 6  # c d z z against c d


def test_seams_without_words(spark):
    segs = [(1, 0, 0, "one two three", 0, 3000), (1, 1, 0, "two three", 1500, 2400), (1, 1, 1, "four", 2600, 5000)]
    chunks = spark.createDataFrame([(1, 0, 3000, False), (1, 1, 6000, False)], CHUNKS)
    (r,) = A.seams_without_words(spark.createDataFrame(segs, "run_id long, chunk long, idx int, text string, start_ms long, end_ms long"), chunks, 1500).collect()
    a, b = list("onetwothree"), list("twothreefour")
    assert (r.method, r.flagged, r.drop_through) == ("no-words", True, 0) and abs(r.score - 2 * longest(a, b) / (len(a) + len(b))) < 1e-12


def test_run_states(spark):
    rows = [(1, "merge", 0, "dead", False), (1, "merge", 1, "done", False), (2, "asr.chunk", 0, "dead", False), (2, "asr.chunk", 1, "done", False), (3, "note", 0, "dead", True), (4, "asr.chunk", 0, "dead", False), (5, "a", 0, "cancelled", False), (6, "a", 0, "cancelled", False), (7, "a", 0, "running", False), (8, "a", 0, "failed", False)]
    steps = spark.createDataFrame(rows, "run_id long, kind string, shard int, state string, optional boolean")
    got = dict(O.run_state(steps, spark.createDataFrame([(5,), (1,)], "run_id long")).collect())
    assert got == {1: "failed", 2: "partial", 3: "done", 4: "failed", 5: "cancelled", 6: "done", 7: "active", 8: "failed"}


def test_glossaries_prefer_long_terms(spark):
    terms = spark.createDataFrame([("g", "a" * 8, 1.0), ("g", "b" * 40, 1.0), ("g", "c" * 4, 2.0), ("h", "မြန်", 0.0)], "g string, term string, boost double")
    got = {r.g: (r.packed, r.used) for r in O.pack_glossary(terms, ["g"], 12).collect()}
    assert got["g"] == (["cccc", "b" * 40], 12) and got["h"] == (["မြန်"], 2)


def test_gate(spark):
    arms = [("en", "control", 9, 0.10, 0.0, 0.0), ("en", "x", 9, 0.12, 0.02, 0.5), ("en", "y", 9, 0.09, 0.001, 0.0), ("fr", "x", 9, 0.1, 0.0, 0.0), ("fr", "y", 9, 0.1, 0.0, 0.0), ("de", "control", 9, 0.1, 0.0, 0.0), ("de", "x", 9, 0.5, 0.0, 0.0)]
    df = spark.createDataFrame(arms, "lang string, arm string, n long, cer_punct double, content_delta double, entity_drift double")
    got = [(r.lang, r.arm, r.failure, None if r.delta is None else round(r.delta, 6)) for r in E.cleanup_gate(df, "control", ["control", "x", "y"], spark.createDataFrame([("es",), ("en",), ("fr",), ("de",)], "lang string")).collect()]
    assert got[:3] == [("en", "x", "entity_drift", 0.48), ("en", "x", "cer_punct", 0.02), ("en", "x", "content_delta", 0.015)]
    assert sorted(got[3:]) == [("de", "x,y", "not_measured", None), ("es", "x,y", "not_measured", None), ("fr", "x", "control_missing", None)]


def test_editing_scores_compare_with_what_was_given(spark):
    rows = [("Un test.", "un test", "UN  test 1/2"), ("the end", "the end", "The end."), ("x", "UN UN 3", "UN 3 3")]
    df = spark.createDataFrame(rows, "ref string, given string, hyp string")
    got = E.cleanup_stats(df).collect()
    assert [(r.edits_c, r.len_c) for r in got] == [(2, 6), (0, 6), (2, 5)]  # spaces, case and marks are free
    assert [(r.drift, r.total, r.lost) for r in got] == [(2, 0, []), (0, 0, []), (2, 3, ["UN"])]
    agg = E.cleanup_aggregate(E.cleanup_stats(df.withColumn("lang", F.lit("en"))), ["lang"]).first()
    assert abs(agg.entity_drift - 4 / 5) < 1e-12 and abs(agg.length_delta - 5 / 21) < 1e-12


def test_bootstrap_in_blocks_and_by_poisson(spark, monkeypatch):
    import xxhash

    rng = random.Random(1)
    rows = [("en" if i % 3 else "fr", i, rng.randint(0, 9), rng.randint(10, 90)) for i in range(200)]
    df = spark.createDataFrame(rows, "lang string, id long, edits long, ref_len long")
    whole = E.bootstrap(df, "lang", "id", b=60).collect()
    monkeypatch.setattr(E, "BOOT_RESAMPLES", 7)
    monkeypatch.setattr(E, "BOOT_DRAWS", 50)
    monkeypatch.setattr(E, "BOOT_PART", 32)
    monkeypatch.setattr(E, "BOOT_MEET", 9)
    for limit in (32, 100, 1000):  # all groups by sent draws, the smaller one held, both held
        monkeypatch.setattr(E, "BOOT_BLOCK", limit)
        assert sorted(map(tuple, E.bootstrap(df, "lang", "id", b=60).collect())) == sorted(map(tuple, whole))
    assert E.bootstrap(df.where("id < 0"), "lang", "id", b=60).count() == 0
    for limit in (32, 1000):
        monkeypatch.setattr(E, "BOOT_BLOCK", limit)
        unnamed = E.bootstrap(df.withColumn("lang", F.lit(None).cast("string")), "lang", "id", b=60).first()
        assert (unnamed.lang, unnamed.n) == (None, 200)
        assert tuple(unnamed)[2:] == tuple(E.bootstrap(df.withColumn("lang", F.lit("x")), "lang", "id", b=60).first())[2:]

    def poisson(i, k):
        h = xxhash.xxh64_intdigest((k).to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=42))
        h = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed=h)
        u, cdf, p, w = ((h & ((1 << 52) - 1)) + 0.5) / (1 << 52), 0.0, 0.36787944117144233, 0
        for n in range(8):
            cdf += p
            w, p = w + (u > cdf), p / (n + 1)
        return w

    for lang, lo, hi in E.poisson_bootstrap(df, "lang", "id", b=40).collect():
        own = [(i, e, n) for l, i, e, n in rows if l == lang]
        ratios = sorted(sum(e * poisson(i, k) for i, e, _ in own) / sum(n * poisson(i, k) for i, _, n in own) for k in range(40))
        assert min(abs(lo - r) for r in ratios[:3]) < 1e-12 and min(abs(hi - r) for r in ratios[-3:]) < 1e-12


def test_every_draw_is_made_once(spark, monkeypatch):
    monkeypatch.setattr(E, "BOOT_BLOCK", 64)
    monkeypatch.setattr(E, "BOOT_PART", 16)
    monkeypatch.setattr(E, "BOOT_DRAWS", 33)
    n, b, rng = 150, 25, random.Random(5)
    edits, lengths = [rng.randint(0, 9) for _ in range(n)], [rng.randint(1, 40) for _ in range(n)]
    df = spark.createDataFrame([("x", i, e, t) for i, (e, t) in enumerate(zip(edits, lengths))], "lang string, id long, edits long, ref_len long")
    clips = df.select("lang", F.lit(n).cast("long").alias("n"), F.col("id").alias("i"), "edits", "ref_len")
    got = {r.k: (r.e, r.t) for r in E._sent_draws(clips, clips.select("lang", "n").distinct(), "lang", "string", b, 7).collect()}
    picks = {k: [int(u * n) for u in E._uniform(7, np.arange(k * n + 1, k * n + n + 1))] for k in range(b)}
    assert got == {k: (sum(edits[i] for i in at), sum(lengths[i] for i in at)) for k, at in picks.items()}


def test_replies(spark):
    cases = {'{"segments":[{"idx":0,"text":"a"},{"idx":0,"text":"b"},{"idx":2,"text":"c"}]}': {0: "a", 2: "c"}, '```json\n[{"idx":1,"text":"x"}]\n```': {1: "x"}, 'Sure: {"segments":[{"idx":3,"text":"y"}]} Bye': {3: "y"},
             "no json": None, '{"segments":[{"idx":"1","text":"x"}]}': None, '{"segments":[{"idx":1.5,"text":"x"},{"idx":4,"text":7}]}': None, '{"segments":[': None, "[]": None}
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    assert {r.r: r.m for r in df.select("r", T.reply_segments(F.col("r")).alias("m")).collect()} == cases


def test_speakers_are_not_merged_with_themselves(spark):
    turns = spark.createDataFrame([(1, "A", 0, 9, 0)], TURN)
    with pytest.raises(Exception, match="merged with itself"):
        S.merge_speakers(turns, spark.createDataFrame([(1, "A", "A")], "run_id long, from_key string, into_key string")).collect()
    with pytest.raises(Exception, match="no reference speech"):
        S.diarization_error(turns.limit(0), turns).collect()


def test_numbers_of_groups(spark):
    from speechlake.sources.scratch import numbered

    rows = [(None if i % 5 == 0 else i % 5 if i % 2 else 7, i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "g int, x int").repartition(7), ["g"], ["x"]).collect()
    for g in {r.g for r in got}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r.x)
        assert [r.i for r in own] == list(range(len(own)))
    assert len(got) == 500


def test_files_of_chunks_and_turns(spark, tmp_path):
    at = f"file://{tmp_path}/chunks"
    files.write_chunk_results(spark.createDataFrame([(1, 0, "x"), (2, 1, "y")], "run_id long, chunk long, body string"), at)
    wanted = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "run_id long, chunk long")
    assert sorted((r.run_id, r.chunk, r.body) for r in files.read_chunk_results(wanted, at).collect()) == [(1, 0, "x"), (1, 1, None), (2, 1, "y")]
    with pytest.raises(Exception, match="no diarization result: running"):
        A.read_turns(spark.createDataFrame([(1, '{"state":"running"}')], "run_id long, body string"), ["run_id"], "body").collect()
    doc = A.transcripts(spark.createDataFrame([(1, 0, "A", "hi", 0, 9)], "run_id long, idx int, speaker_key string, text string, start_ms long, end_ms long"), spark.createDataFrame([(1, 0, 0, "hi", 0, 9)], "run_id long, idx int, word_idx int, text string, start_ms long, end_ms long"),
                        runs=spark.createDataFrame([(1, "m")], "run_id long, model string"), chunks=spark.createDataFrame([(1, 0, 9, True)], CHUNKS)).first().document
    assert '"model":"m"' in doc and "chunk 0 failed" in doc


def test_chunk_plan_cuts_at_silences(spark):
    assets = spark.createDataFrame([(1, 70_000), (2, 0), (3, 5_000)], "asset_id long, duration_ms long")
    silences = spark.createDataFrame([(1, 20_000), (1, 26_000), (1, 29_500)], "asset_id long, at_ms long")
    got = {}
    for r in A.chunk_plan(assets, silences, 30_000, 2_000).collect():
        got.setdefault(r.asset_id, []).append((r.idx, r.offset_ms, r.content_start_ms, r.end_ms))
    assert sorted(got[1]) == [(0, 0, 0, 26_000), (1, 24_000, 26_000, 54_000), (2, 52_000, 54_000, 70_000)] and got[3] == [(0, 0, 0, 5_000)] and 2 not in got


def test_rttm_refuses_bad_lines(spark):
    good = spark.createDataFrame([("",), (";; note",), ("SPKR-INFO x",), ("SPEAKER f 1 0.5 1.25 <NA> <NA> s1 <NA> <NA>",)], "value string")
    assert [tuple(r) for r in A.read_rttm(good).collect()] == [("f", "s1", 500, 1750)]
    with pytest.raises(Exception, match="not a speaker line"):
        A.read_rttm(spark.createDataFrame([("SPEAKER f 1 x 1 a b c",)], "value string")).collect()


def test_urls_and_names(spark):
    cases = {"http://10.1.2.3/": "private", "http://[::1]/": "private", "http://[::ffff:10.0.0.1]/x": "private", "http://172.32.0.1/": None, "http://100.64.0.1": "private", "ftp://a.b/": "scheme", "http:///x": "host", "https://user@LOCALHOST:80/": "private", "https://a.b/c": None, "http://224.0.0.1/": "private"}
    df = spark.createDataFrame(list(cases.items()), "u string, want string")
    assert all(r.got == r.want for r in df.select("u", "want", O.url_refusal(F.col("u")).alias("got")).collect())
    names = {"a/b.mp3": None, " ": "empty", "x/..": "dot", "a\x07": "control", "é" * 128: "long"}
    df = spark.createDataFrame(list(names.items()), "n string, want string")
    assert all(r.got == r.want for r in df.select("n", "want", O.file_name_problem(F.col("n")).alias("got")).collect())


def test_scalars(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first().x
    lit = F.lit
    assert [one(T.offset_ms(lit(x))) for x in ("1.5s", "2", '{"seconds":"3","nanos":500000000}', "x", None)] == [1500, 2000, 3500, None, None]
    assert [one(T.parse_clock(lit(x))) for x in ("1:02.4", "1:00:00", "-1:2,05", "nope")] == [62_400, 3_600_000, -62_050, None]
    assert [one(T.clock(lit(x))) for x in (65_000, 3_723_400, -1_500)] == ["01:05.000", "01:02:03.400", "-00:01.500"] and one(T.clock(lit(0), with_ms=False, always_hours=True)) == "00:00:00"
    assert one(T.subtitle_time(lit(-1500))) == "00:00:00,000" and one(T.subtitle_time(lit(59_999.6))) == "00:01:00,000"
    assert one(T.entities(lit("UN a 1/2, 1755. B2 NGOs"))) == ["UN", "1/2", "1755", "2", "NGO"] and one(T.entities(lit("ring\u104a ကceo"), False)) == ["ring", "ceo"]
    assert one(T.strip_prompt_echo(lit("  Hello world again — so"), lit("Hello world again"))) == "so"
    assert one(T.strip_prompt_echo(lit("Hello world again, yes"), lit("Hello world again"))) == "yes" and one(T.strip_prompt_echo(lit("Hello"), lit("Hello"))) == "Hello"
    assert one(files.silences(lit("silence_start: 1.5 x\nsilence_end: 0.25"))) == [250, 1500] and one(files.silences(lit("none"))) == []
    assert tuple(one(files.probe(lit('{"format":{"duration":"N/A","format_name":"wav"},"streams":[{}]}')))) == (None, "wav", 1)
    assert one(T.billed_seconds(lit("12.5s"))) == 12.5 and one(T.billed_seconds(lit("12"))) is None


def test_readers(spark, tmp_path):
    (tmp_path / "e.tsv").write_bytes(b'1\tf\t"say ""hi""\nthere"\tp\tg\t16000\tFEMALE\r\n\r\nx\tf\tr\tp\tg\t1\tM\n2\tshort\n3\tf\tr\tp\tg\t5\tM')
    rows, dropped = files.read_eval_rows(spark, f"file://{tmp_path}/e.tsv")
    assert [(r.id, r.raw.replace("\r", "")) for r in rows.orderBy("id").collect()] == [(1, 'say "hi"\nthere'), (3, "r")] and dropped.first().dropped == 2
    (tmp_path / "m.csv").write_text("# remark\npath,title,language,provider,model\na.mp3, ,fr,,m\n")
    assert [tuple(r) for r in files.read_manifest(spark, f"file://{tmp_path}/m.csv", title="T", provider="P").collect()] == [("a.mp3", "T", "fr", "P", "m")]
    with pytest.raises(Exception, match="not finite"):
        files.finite(spark.createDataFrame([(float("nan"),)], "x double"), ["x"]).collect()
    files.write_tiers(spark.createDataFrame([("en", "beta")], "lang string, tier string"), f"file://{tmp_path}/tiers")
    assert files.read_tiers(spark, f"file://{tmp_path}/tiers", "lang string, tier string").first().tier == "beta"
    (tmp_path / "old.json").write_text('{"schemaVersion": 9, "lang": "en", "tier": "x"}')
    with pytest.raises(Exception, match="unknown schema version"):
        files.read_tiers(spark, f"file://{tmp_path}/old.json", "lang string, tier string").collect()
