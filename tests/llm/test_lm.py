import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from speechlake.llm import lm as L
from speechlake.llm.elias_fano import EliasFano, Trie


def test_sequences():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (5, 3), (500, 10**6), (3000, 2**40), (3000, 50)):
        v = np.sort(rng.integers(0, top, n))
        e = EliasFano(EliasFano.pack(v))
        assert (e[np.arange(n)] == v).all()
        x = np.concatenate([rng.integers(0, top + 5, 300), v[:50], v[-5:] + 1, [0, top * 4]])
        assert (e.successor(x) == np.searchsorted(v, x, "left")).all()


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 60, (900, 2)), axis=0)
    gain = rng.random(len(pairs)) * 9 + 0.1
    t = Trie(Trie.pack(pairs[:, 0], pairs[:, 1], gain))
    want = {(a, b): g for (a, b), g in zip(pairs.tolist(), gain)}
    q = rng.integers(0, 70, (4000, 2))
    for (a, b), code in zip(q.tolist(), t.look_up(q[:, 0], q[:, 1], 333)):
        assert (code > 0) == ((a, b) in want) and abs(code * Trie.STEP - want.get((a, b), 0)) <= Trie.STEP / 2 + 1e-9
    empty = np.zeros(0, np.int64)
    assert Trie(Trie.pack(empty, empty, empty)).look_up(np.array([1]), np.array([2])).tolist() == [0]


def brute(rows, mu=L.MU):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c, c2 = Counter(), Counter()
    for t, h in zip(toks, held):
        if not h:
            c.update(t)
            c2.update(zip([None] + t, t))
    n, v = sum(c.values()), len(c)
    base = lambda w: (c[w] + 1) / (n + v + 1)
    for (i, _), t, h in zip(rows, toks, held):
        b = sum(math.log10(base(w)) for w in t)
        s = sum(math.log10((c2[p] + mu * base(p[1])) / (c[p[0]] + mu)) for p in zip([None] + t, t))
        yield (-1 if i is None else i, h, len(t), sum(c[w] > 0 for w in t), n), b, s


def test_matches_brute_force(spark):
    rng = random.Random(6)
    vocab = ["The", "of", "É", "x y", "</s>", "a", "|", "|", "|"] + [f"w{k}" for k in range(40)]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(None, "a of"), (500, None), (501, ""), (3, "repeated row of a"), (600, "the of | " * 5000)]
    df = spark.createDataFrame([(i, t, True, 1) for i, t in rows], "doc_id long, text string, held_out boolean, batch int")
    want = sorted(brute(rows))
    for size in (L.BATCH_BYTES, 700):
        got = sorted(((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score, r.score) for r in L.score_documents(df, batch_bytes=size).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        for g, w in zip(got, want):
            assert abs(g[1] - w[1]) < 1e-6 * (1 + abs(w[1])) and abs(g[2] - w[2]) <= g[0][2] * Trie.STEP / 2 + 1e-6


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert L.score_documents(spark.createDataFrame([], schema)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = L.score_documents(spark.createDataFrame([(held, "a b")], schema)).collect()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)
