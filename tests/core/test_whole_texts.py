"""Scores over all of each text, on small fixtures."""

import random

from pyspark.sql import functions as F

from speechlake.functions import metrics as M
from speechlake.plans import evaluation


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_of_long_texts_are_exact(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé日") for _ in range(n))
    rows = [("", ""), ("", word(50)), (word(90), word(90))] + [(word(rng.randint(0, 120)), word(rng.randint(0, 120))) for _ in range(20)]
    for _ in range(10):
        t = word(300)
        rows.append(("".join(c for c in t if rng.random() > 0.05), t))
    df = spark.createDataFrame(rows + [(None, "a")], "h string, r string")
    got = {(r.h, r.r): r.n for r in df.select("h", "r", M.char_edits(F.col("h"), F.col("r")).alias("n")).collect()}
    assert got == {(h, r): brute(h, r) for h, r in rows} | {(None, "a"): None}


def test_poisson_interval_sees_the_ends_of_texts(spark, tmp_path):
    text = "abcde fgij " * 40 + "the thin path " * 10
    spark.createDataFrame([(i, text, "en", "src0", len(text)) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = evaluation.bootstrap_poisson(spark, str(tmp_path)).collect()
    clips = [text[i : i + 240] for i in range(0, len(text), 240)]
    form = lambda t: " ".join(t.split())
    want = sum(brute(form(c.replace("th", "t")), form(c)) for c in clips) / sum(len(form(c)) for c in clips)
    assert want > 0.04
    assert abs(r.poisson_lo - want) < 1e-12 and abs(r.poisson_hi - want) < 1e-12
