import random
import re

import pandas as pd
from pyspark.sql import functions as F

from speechlake.functions import metrics as M
from speechlake.functions import text as T
from speechlake.operators import evaluation as E


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edits_of_batches_equal_the_whole_table(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, n)))
    pairs = [(text(60), text(60)) for _ in range(150)]
    pairs += [(a, "".join(x for x in a if rng.random() < 0.9) + rng.choice(["", "x"])) for a, _ in pairs] + [("", ""), ("", "a"), ("\0", ""), ("ab" * 300, "ba" * 290), (None, "a"), ("a", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for i, n in df.select("i", M.char_edits(F.col("a"), F.col("b"))).collect():
        assert n == (None if None in pairs[i] else edits(*pairs[i])), pairs[i]


def test_edits_are_not_left_to_the_builtin_table(spark):
    """The built-in distance took 545 us a pair of 240 characters."""
    df = spark.createDataFrame([("a", "b")], "a string, b string").select(M.char_edits(F.col("a"), F.col("b")))
    assert "levenshtein" not in df._jdf.queryExecution().executedPlan().toString()


def test_spaces_collapse_to_one_blank(spark):
    texts = [" a  b ", "a\tb", "a 　 b", " a b ", "a b", "   ", "a \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.collapse_space(F.col("t"))).collect()] == ["a b", "a b", "a b", "a b", "a b", "", "a"]


def test_grapheme_rates_of_low_characters(spark):
    df = spark.createDataFrame([("a\r\nb", "a\r\nc"), ("a\rb", "a\nb"), ("é", "e"), ("", "a"), ("", ""), ("éx", "ex")], "h string, r string")
    got = [r[0] for r in df.select(M.grapheme_cer(F.col("h"), F.col("r"))).collect()]
    assert got == [1 / 3, 1 / 3, 1.0, 1.0, 0.0, 0.5]


def test_a_language_report_scores_its_clips_once(spark, sf_dir, monkeypatch):
    from speechlake.plans import evaluation as P

    calls, clips = [], P._clips
    monkeypatch.setattr(P, "_clips", lambda *args: calls.append(1) or clips(*args))
    P.language_report(spark, sf_dir)
    assert len(calls) == 1


def test_length_of_a_common_subsequence():
    import time

    from speechlake.operators import assembly as A

    rng = random.Random(2)
    text = lambda n, of: [rng.choice(of) for _ in range(n)]
    for _ in range(300):
        a, b = text(rng.randint(0, 40), "abcd"), text(rng.randint(0, 40), "abcde")
        assert A.lcs_length(a, b) == len(A.lcs_pairs(a, b))
    a, b = text(400, "abcdef ghi"), text(400, "abcdef ghi")
    start = time.perf_counter()
    n = len(A.lcs_pairs(a, b))
    middle = time.perf_counter()
    assert A.lcs_length(a, b) == n and (time.perf_counter() - middle) * 5 < middle - start


def test_word_edits_are_not_left_to_the_builtin_table(spark):
    df = E.word_stats(spark.createDataFrame([("a b", "b")], "h string, r string"))
    assert "levenshtein" not in df._jdf.queryExecution().executedPlan().toString()


def test_word_edits_of_batches_equal_the_whole_table(spark, monkeypatch):
    rng = random.Random(7)
    spaces = [*T.WHITE, "  ", " \n", " ", " ", " "]
    odd = lambda n: "".join(rng.choice("aé\U0001f600\x1c\x85\0") + rng.choice(["", *spaces]) for _ in range(rng.randint(0, n)))
    plain = lambda n: " ".join(rng.choice(["a", "b", "été", "c"]) for _ in range(rng.randint(0, n)))
    pairs = [(t(40), t(40)) for t in (odd, plain) for _ in range(150)] + [("", ""), ("", " a"), ("a b", "﻿"), (None, "a"), ("a", None), ("x " * 900, "x y " * 400)]
    split = lambda t: [w for w in re.split(f"[{T.WHITE}]+", t) if w]
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "i int, h string, r string")
    for row in E.word_stats(df).collect():
        want = (None, None) if None in pairs[row.i] else (edits(*map(split, pairs[row.i])), len(split(row.r)))
        assert (row.word_edits, row.ref_words) == want, pairs[row.i]
    whole = [tuple(x) for x in zip(*[M._word_counts_of.func(*[pd.Series(side, dtype=object) for side in zip(*pairs)])[c].fillna(-1) for c in ("edits", "words")])]
    monkeypatch.setattr(M, "WORD_CHARS", 100)
    assert whole == [tuple(x) for x in zip(*[M._word_counts_of.func(*[pd.Series(side, dtype=object) for side in zip(*pairs)])[c].fillna(-1) for c in ("edits", "words")])]


def test_tables_of_characters_equal_the_patterns(spark):
    marks = "[\\u200B\\uFEFF\\u200E\\u200F\\u061C\\u202A-\\u202E\\u2066-\\u2069]"
    df = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.concat(F.lit("a"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"), F.lit(" b\n")).alias("t"))
    space = F.trim(F.regexp_replace("t", T.SPACE, " "))
    assert df.where((T.collapse_space(F.col("t")) != space) | (T.collapse_space(F.col("t"), True) != F.regexp_replace("t", T.SPACE, "")) | (T.strip_zero_width(F.col("t"), bidi=True) != F.regexp_replace("t", marks, ""))).count() == 0
