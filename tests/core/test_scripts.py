import random

import pytest
from pyspark.sql import functions as F

from speechlake.functions import scripts as S
from speechlake.operators import evaluation as E

NAMES = {"Latn": ["Latin"], "Cyrl": ["Cyrillic"], "Grek": ["Greek"], "Arab": ["Arabic"], "Deva": ["Devanagari"], "Mymr": ["Myanmar"], "Hani": ["Han"], "Hira": ["Hiragana"], "Kana": ["Katakana"], "Hang": ["Hangul"], "Jpan": ["Hiragana", "Katakana", "Han"]}


@pytest.fixture(scope="module")
def words(spark):
    return S.dictionary(S.scripts_table(spark, NAMES))


def texts(n):
    rng = random.Random(n)
    pool = ["abcXYZ", "éßøŁ", "жЯё", "αβΩ", "ابت", "कखि", "မြန်", "漢字", "ひら", "カナ", "한글", " .,!?", "0123", "🙂", "\U00020000", "̈", "ª"]
    return [(i, "".join(rng.choice(rng.choice(pool)) for _ in range(rng.randint(0, 40)))) for i in range(n)] + [(n, ""), (n + 1, None)]


def test_counts_equal_those_of_the_classes(spark, words):
    df = spark.createDataFrame(texts(300), "id int, text string")
    got = df.withColumn("n", S.script_counts(F.col("text"), words))
    for code, pattern in E.CENSUS.items():
        bad = got.where(F.coalesce(F.col("n")[code], F.lit(0)) != F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)))
        assert bad.count() == 0, code
    assert got.where(F.coalesce(F.col("n")["Jpan"], F.lit(0)) != F.coalesce(F.col("n")["Hani"], F.lit(0)) + F.coalesce(F.col("n")["Hira"], F.lit(0)) + F.coalesce(F.col("n")["Kana"], F.lit(0))).count() == 0


def test_integrity_equals_that_of_the_class(spark, words):
    df = spark.createDataFrame(texts(300), "id int, text string").fillna("")
    plain = spark.createDataFrame([("Latn", 0x41, 0x5A), ("Latn", 0x61, 0x7A), ("Grek", 0x3B1, 0x3C9)], "script string, lo int, hi int").unionByName(S.scripts_table(spark, {}))
    old = E.script_integrity(df, ["id"], "text", [(0x41, 0x5A), (0x61, 0x7A)])
    new = df.select("id", S.script_integrity(F.col("text"), F.array(F.lit("Latn")), S.dictionary(plain)).alias("x")).select("id", "x.*")
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.select("id", "counted", "in_script", "fraction", "strays").collect()))


def test_each_row_has_its_own_scripts(spark, words):
    rows = [(1, "abc жя", ["Latn"]), (2, "abc жя", ["Cyrl", "Latn"]), (3, "abc", []), (4, "abc", None), (5, "漢字かな", ["Jpan"]), (6, "漢字かな", ["Hani", "none"]), (7, "123", ["Latn"]), (8, None, ["Latn"])]
    df = spark.createDataFrame(rows, "id int, text string, accepted array<string>")
    got = {r.id: (r.x.counted, r.x.in_script, r.x.fraction, "".join(r.x.strays)) for r in df.select("id", S.script_integrity(F.col("text"), F.col("accepted"), words).alias("x")).collect()}
    assert got == {1: (5, 3, 0.6, "жя"), 2: (5, 5, 1.0, ""), 3: (3, 0, 0.0, "abc"), 4: (3, 0, 0.0, "abc"), 5: (4, 4, 1.0, ""), 6: (4, 2, 0.5, "かな"), 7: (0, 0, None, ""), 8: (0, 0, None, "")}
    registry = spark.createDataFrame([("sr", "Cyrl", ["Latn"]), ("en", "Latn", None)], "code string, script string, alt_scripts array<string>")
    langs = spark.createDataFrame([("sr",), ("en",), ("xx",)], "lang string")
    assert {r.lang: r.accepted for r in S.accepted_scripts(langs, registry).collect()} == {"sr": ["Cyrl", "Latn"], "en": ["Latn"], "xx": []}
    assert df.limit(0).select(S.script_counts(F.col("text"), words)).collect() == []


def test_bad_ranges_are_refused(spark):
    for row in (("a", 5, 4), ("a", -1, 4), ("a", 1, 0x110000), (None, 1, 2), ("a", None, 2)):
        with pytest.raises(ValueError, match="no range"):
            S.dictionary(spark.createDataFrame([row], "script string, lo int, hi int"))
    d = S.dictionary(spark.createDataFrame([("a", 5, 9), ("b", 8, 12), ("a", 9, 10)], "script string, lo int, hi int"))
    assert d.starts.tolist() == [0, 5, 8, 9, 10, 11, 13] and d.member.tolist() == [[False, False], [True, False], [True, True], [True, True], [True, True], [False, True], [False, False]]
