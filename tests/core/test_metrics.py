"""Pair metrics against plain walks, and properties of the normaliser and of intervals."""

import random
from collections import Counter

from pyspark.sql import functions as F

from speechlake.functions import metrics as M
from speechlake.functions import text as T
from speechlake.operators import evaluation as E


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_rates_of_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    pairs = [("", ""), ("", "a b"), ("a b", ""), ("the\tcat", "the cat"), ("é", "e")] + [(" ".join(word() for _ in range(rng.randint(0, 9))), " ".join(word() for _ in range(rng.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "id int, h string, r string")
    w = M.wer(F.col("h"), F.col("r"))
    for row in df.select("h", "r", M.cer(F.col("h"), F.col("r")).alias("cer"), w["value"].alias("wer"), M.wer(F.col("h"), F.col("r"), "icu")["kind"].alias("kind")).collect():
        hw, rw = row.h.split(), row.r.split()
        want = lambda a, b: edits(a, b) / len(b) if b else (0.0 if not a else None)
        assert row.cer == want(row.h, row.r) and row.wer == want(hw, rw) and row.kind is None


def brute_chrf(pairs, char_order=6, word_order=0, beta=2.0):
    def edge(s):
        out = []
        for w in s.split():
            if len(w) == 1:
                out.append(w)
            elif w[-1] in M.EDGE_MARKS:
                out += [w[:-1], w[-1]]
            elif w[0] in M.EDGE_MARKS:
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return out

    stats = []
    for units, order in ((lambda s: list("".join(s.split())), char_order), (edge, word_order)):
        for n in range(1, order + 1):
            tot = [0, 0, 0]
            for h, r in pairs:
                a, b = (Counter(tuple(u[i : i + n]) for i in range(len(u) - n + 1)) for u in (units(h), units(r)))
                for k, v in enumerate((sum(a.values()) if b else 0, sum(b.values()), sum((a & b).values()))):
                    tot[k] += v
            stats.append(tot)
    full = [s for s in stats if s[0] and s[1]]
    if not full:
        return 0.0
    p, r = (sum(s[2] / s[i] for s in full) / len(full) for i in (0, 1))
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def test_corpus_chrf(spark):
    groups = {"a": [("hello there", "hello here"), ("(hi) you!", "hi you"), ("", "x")], "b": [("ab", "ab"), ("\"q\"", "q")], "c": [("", "")], "d": [("abc", "xyz")]}
    df = spark.createDataFrame([(g, i, h, r) for g, ps in groups.items() for i, (h, r) in enumerate(ps)], "lang string, id int, hyp string, ref string")
    for order in (0, 2):
        got = {r.lang: r.chrf for r in E.corpus_chrf(df, ["lang"], word_order=order).collect()}
        for g, ps in groups.items():
            assert abs(got.get(g, 0.0) - brute_chrf(ps, word_order=order)) < 1e-9


def test_scoring_form_is_idempotent(spark):
    texts = ["  A​ b 　C! ", "éx", "‏RTL‪", "10% of ၁၂", "", "...", "İ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = T.scoring_form(F.col("t"), digit_sets=["၀၁၂၃၄၅၆၇၈၉", "short"])
    rows = df.select(once.alias("a")).select("a", T.scoring_form(F.col("a")).alias("b")).collect()
    assert [r.a for r in rows][:6] == ["a b c", "éx", "rtl", "10 of 12", "", ""] and all(r.a == r.b for r in rows)
    try:
        T.scoring_form(F.col("t"), needs_converter=True)
        raise AssertionError
    except ValueError:
        pass


def test_seeded_draws_equal_a_walk(spark):
    def walk(seed, n):
        a, out = seed & 0xFFFFFFFF, []
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ a >> 15) * (1 | a)) & 0xFFFFFFFF
            t = ((t + ((t ^ t >> 7) * (61 | t))) & 0xFFFFFFFF) ^ t
            out.append(((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296)
        return out

    df = T.seeded_uniform(spark.range(1, 501), 99, F.col("id"), "u")
    assert [r.u for r in df.orderBy("id").collect()] == walk(99, 500)


def test_bootstrap_properties(spark):
    rows = [("one", 1, 2, 10)] + [("many", i, i % 4, 10) for i in range(40)] + [("zero", 1, 0, 0)]
    df = spark.createDataFrame(rows, "lang string, id int, edits int, ref_len int")
    got = {r.lang: (r.lo, r.hi) for r in E.bootstrap(df, "lang", "id", b=200, seed=3).collect()}
    assert got["one"] == (0.2, 0.2) and got["zero"] == (0.0, 0.0) and got["many"][0] < 0.15 < got["many"][1]
    assert got == {r.lang: (r.lo, r.hi) for r in E.bootstrap(df, "lang", "id", b=200, seed=3).collect()}


def test_tiers(spark):
    rows = [("ok", 0.1, 0.11, 1.0, 1.0, 100, True), ("wide", 0.1, 0.3, 1.0, 1.0, 100, True), ("script", 0.01, 0.02, 1.0, 0.5, 100, True), ("bad", 0.7, 0.8, 1.0, 1.0, 100, True), ("none", None, None, None, None, 0, False), ("slow", 0.3, 0.4, 1.9, 1.0, 100, True), ("far", 0.3, 0.4, 3.0, 1.0, 100, True), ("noci", 0.1, None, 1.0, 1.0, 100, True)]
    df = spark.createDataFrame(rows, "k string, cer double, hi double, ratio double, si double, n int, rev boolean")
    t = E.tier(*[F.col(c) for c in ("cer", "hi", "ratio", "si", "n", "rev")])
    got = {r.k: (r.t.tier, r.t.reason, list(r.t.blocked)) for r in df.select("k", t.alias("t")).collect()}
    assert got["ok"] == ("verified", "measured", []) and got["script"][:2] == ("unsupported", "script-integrity") and got["bad"][0] == "unsupported"
    assert got["none"][:2] == ("experimental", "not-run") and got["slow"][0] == "beta" and got["far"][0] == "experimental" and "ciHi>0.20" in got["noci"][2] and got["wide"][0] == "beta"


def test_rows_of_one_row_group_are_spread(spark):
    from speechlake.sources.views import spread

    # a file of one row group is cut into as many parts as there are cores, and one of them has all rows
    rows = spark.range(1000).withColumn("p", F.lit(0)).repartition(spark.sparkContext.defaultParallelism, "p")
    assert len(rows.select(F.spark_partition_id()).distinct().collect()) == 1
    assert len(spread(rows).select(F.spark_partition_id()).distinct().collect()) >= spark.sparkContext.defaultParallelism


def test_characters_of_a_class_are_counted_by_code_points(spark):
    from speechlake.functions import text as T

    rows = spark.createDataFrame([("aÀ×中\U00020000 1é",), ("",), (None,)], "c string")
    for kind, pattern in (("\\p{L}\\p{M}", "[\\p{L}\\p{M}]"), ("\\p{L}\\p{M}&&[\\x{41}-\\x{7A}]", "[\\p{L}\\p{M}&&[\\x{41}-\\x{7A}]]"), ("\\p{IsHan}", "\\p{IsHan}")):
        assert all(r.a == r.b for r in rows.select(T.count_of(F.col("c"), kind).alias("a"), F.regexp_count("c", F.lit(pattern)).alias("b")).collect())


def test_grams_of_pairs_are_told_apart(spark):
    import random
    from collections import Counter

    from speechlake.functions import metrics as M

    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("ab é😀") for _ in range(rng.choice([0, 1, 2, 9, 40]))) for _ in range(2)) for _ in range(200)]

    def brute(h, r, order):
        out = []
        for n in range(1, order + 1):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
            out += [sum(a.values()) if b else 0, sum(b.values()), sum((a & b).values())]
        return out

    rows = spark.createDataFrame(pairs, "h string, r string").coalesce(1)
    got = rows.select("h", "r", M.ngram_stats(3)("h", "r").alias("c"), M.ngram_stats(2, True)(M.words(F.col("h")), M.words(F.col("r"))).alias("w")).collect()
    assert all(x.c == brute(x.h, x.r, 3) and x.w == brute([w for w in x.h.split(" ") if w], [w for w in x.r.split(" ") if w], 2) for x in got)
