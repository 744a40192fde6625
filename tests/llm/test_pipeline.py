import random

import numpy as np

import corpus_pipeline as P
from speechlake.llm import toxicity as X
from speechlake.llm.tokens import default_path, json_tokenizer

from .test_suffix_dedup import brute as repeats


def groups(rows):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top[i], top[j]))
                top = {k: a if v == b else v for k, v in top.items()}
    return {i for i in ids if top[i] == i}


def test_run_matches_brute_force(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(40))
    docs = []
    for i in range(150):
        text = ". ".join(" ".join(word() for _ in range(8)) for _ in range(rng.randint(1, 9)))
        if i % 6 == 0:
            text += ". you " + rng.choice(["idiot", "scum"]) + " you"
        if i % 5 == 1:
            text += " " + passage
        if i % 7 == 3 and docs:
            text = docs[rng.randrange(len(docs))][1] + " tail"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
    labels = [(i, 1, int("idiot" in d[1] or "scum" in d[1])) for i, d in enumerate(docs)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = P.run(spark, f"file://{tmp_path}").collect()

    read = spark.read.parquet
    weights = X.train(read(f"file://{tmp_path}/documents.parquet"), read(f"file://{tmp_path}/labels.parquet"))
    weights = X.WordWeights(weights)
    rows = [d for d in docs if X.bag_scores(d[1], weights)[0] < X.THRESHOLD]
    assert 0 < len(docs) - len(rows) < 60
    heads = groups([(d[0], d[1]) for d in rows])
    rows = [d for d in rows if d[0] in heads]
    removed = {i: (n, gone) for i, n, gone, *_ in repeats([(d[0], d[1]) for d in rows])}
    ids = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert set(ids) == {d[0] for d in rows}
    tok = json_tokenizer(default_path("byte_bpe_50k.json"))
    for d in rows:
        assert ids[d[0]][-1] == 1
        assert len(tok.decode(ids[d[0]][:-1]).encode()) == removed[d[0]][0] - removed[d[0]][1]


def test_stages_keep_columns_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (2, "again", "en", "s", 5), (3, "é" * 300, "fr", None, 300)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for frame in (docs, docs.limit(0)):
        out = frame
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, out, f"file://{tmp_path}")
            assert out.schema.simpleString() == docs.schema.simpleString()
            out.collect()
        P.STAGES[-1][1](spark, out, f"file://{tmp_path}").collect()


def test_rows_keep_their_own_texts(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(2, "short one", "en", "s", 9), (2, "a rather longer second row of the same id", "de", "t", 41), (None, "without an id it stays", "en", "s", 22), (None, "and so does this one", "en", "s", 20), (4, None, None, None, None)]
    df = spark.createDataFrame(docs, schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for _, stage in P.STAGES[:-1]:
        df = stage(spark, df, f"file://{tmp_path}")
        got = sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=str)
        assert [(i, t or "", a, b) for i, t, a, b in got] == sorted(((i, t or "", a, b) for i, t, a, b, _ in docs), key=str)
    again = P.STAGES[1][1](spark, spark.createDataFrame(docs + docs, schema), f"file://{tmp_path}")
    assert sorted(r.text or "" for r in again.collect()) == sorted(d[1] or "" for d in docs)
