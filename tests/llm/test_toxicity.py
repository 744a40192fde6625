import random
import zlib

import numpy as np

from speechlake.llm import toxicity as X


def made(n, rng):
    plain = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        sents = [" ".join(rng.choice(plain) for _ in range(6)) for _ in range(rng.randint(1, 8))]
        if toxic:
            sents[rng.randrange(len(sents))] += " " + rng.choice(["idiotic", "idiotisch", "idiotas"])
        docs.append((i, ". ".join(sents) + ".", "clash"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_from_document_labels_and_locates(spark):
    docs, labels = made(600, random.Random(1))
    odd = [(None, None, "a"), (9000, "", "a"), (9001, None, "a"), (9002, "...!!\n", "a"), (9003, docs[0][1] * 400, "a"), (0, docs[0][1], "a")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    lab = spark.createDataFrame([(i, 1, t) for i, t in labels] + [(None, 0, 1), (77, 1, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = X.score_toxicity(df, lab).collect()
    assert len(rows) == len(docs) + len(odd)
    by = {r.doc_id: r for r in rows}
    for i, text, _ in docs:
        r = by[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out:
            assert r.predicted == labels[i][1]
        if r.predicted:
            assert "idiot" in text[r.worst_start : r.worst_end]
    assert by[9000].score == by[9001].score == by[9002].score == by[None].score == X.LEAK and by[9003].predicted == 1
    model = X.train(df, lab)
    spots = X.offending_sentences(df.where("doc_id < 600"), model).collect()
    assert spots and all("idiot" in r.sentence for r in spots)


def test_score_is_the_leaky_noisy_or():
    weights = X.WordWeights({"bad": 7.0, "good": -1.0})
    score, parts = X.bag_scores("bad bad. good\nfine", weights)
    sig = lambda z: 1 / (1 + np.exp(-z))
    p = [sig(X.BIAS + 7.0) - sig(X.BIAS), 0.0, 0.0]  # what a sentence has above the bias alone
    assert np.allclose([x for x, _, _ in parts], p) and abs(score - (1 - (1 - X.LEAK) * np.prod([1 - x for x in p]))) < 1e-12


def test_fit_follows_the_likelihood_of_the_score():
    docs, labels = made(120, random.Random(2))
    texts, y = [t for _, t, _ in docs], np.array([t for _, t in labels])

    def loss(w):
        s = np.array([X.bag_scores(t, X.WordWeights(w))[0] for t in texts])
        return -np.mean(np.where(y == 1, np.log(s), np.log1p(-s)))

    fitted = X.fit(texts, y, l1=0.0)
    assert loss(fitted) < 0.05 < loss({})
    for f in list(fitted)[:4]:  # brute force: no single weight can be moved to a clearly better likelihood
        for d in (-1.0, 1.0):
            assert loss(fitted | {f: fitted[f] + d}) > loss(fitted) - 0.01


def test_long_labelled_rows_are_passed_over_whole(spark):
    docs = [(i, "fine words here. " + ("idiot. " if i % 2 else "")) for i in range(60)] + [(100, "idiot " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 2 or i == 100)) for i, _ in docs], "doc_id long, toxic int")
    assert X.train(df, lab, max_chars=20_000) == X.train(df.where("doc_id < 100"), lab, max_chars=20_000)


def test_keep_clean_keeps_rows_as_they_are(spark):
    docs, labels = made(300, random.Random(4))
    rows = [(i, t, "x", [1, i]) for i, t, _ in docs] + [(None, None, None, None), (3, docs[3][1], "x", [1, 3]), (9000, "", "y", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, body array<long>")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = X.keep_clean(df, lab)
    assert kept.schema == df.schema
    weights = X.WordWeights(X.train(df, lab))
    want = [r for r in rows if X.bag_scores(r[1] or "", weights)[0] < X.THRESHOLD]
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, want))
    assert X.keep_clean(df.limit(0), lab).collect() == []


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a b."), (2, "c")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in X.score_toxicity(docs, empty).collect())
    assert X.score_toxicity(docs.limit(0), empty).collect() == []
    assert X.fit(["a"] * 9, np.zeros(9)) == {}
