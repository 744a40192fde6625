import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from speechlake.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    found = [(i, Counter(split(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, total, df = len(found), sum(sum(c.values()) for _, c in found), Counter(t for _, c in found for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for doc, c in found:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        scored.sort()
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(scored[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_terms(monkeypatch):
    monkeypatch.setattr(R, "PART", 7)
    rng = random.Random(2)
    for _ in range(500):
        t = "".join(rng.choices(["a", "B", "Z9", " ", "-", "_", "é", "É", " ", "中", "\x00", "\x7f", "\n", "@", "[", "`", "{", "🙂"], k=rng.randint(0, 40)))
        assert [x.decode() for some in R.terms_of(t) for x in some] == split(t)


@pytest.mark.parametrize("first, longer", [(1, 2), (3, 4), (10_000, 2)])
def test_intervals_close_on_the_best_of_a_shard(first, longer, monkeypatch):
    monkeypatch.setattr(R, "FIRST_READ", first)
    monkeypatch.setattr(R, "LONGER", longer)
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, t, k = int(rng.integers(1, 200)), int(rng.integers(1, 12)), int(rng.integers(1, 12))
        has = rng.random((n, t)) < rng.random(t)
        impact = rng.integers(1, rng.choice([3, 1000]), (n, t)) * has
        doc, term = np.nonzero(has)
        shard = R.Shard(term, doc, impact[doc, term], n, t)
        terms, factors, ids = rng.permutation(t)[: int(rng.integers(1, t + 1))], rng.integers(0, 5, t), rng.permutation(n)
        factors = factors[: len(terms)]
        scores = impact[:, terms] @ factors
        want = [(int(d), int(scores[d])) for d in np.lexsort((ids, -scores))[:k] if scores[d] > 0]
        docs, found, read = shard.search(terms, factors, ids, k)
        assert list(zip(docs.tolist(), found.tolist())) == want and read <= len(doc)


def test_reading_stops_before_the_end_of_long_lists():
    n = 10_000
    impact = np.arange(n, 0, -1)
    shard = R.Shard(np.zeros(n, np.int64), np.arange(n), impact, n, 1)
    docs, _, read = shard.search(np.array([0]), np.array([2]), np.arange(n), 10)
    assert docs.tolist() == list(range(10)) and read < n // 10


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD_DOCS", 37)
    monkeypatch.setattr(R, "BLOCK_TERMS", 14)
    rng = random.Random(4)
    words = ["the", "The", "of", "rare", "ünter", "中文", "x1", "Zeta", "omega", "a", "b", "c", "d"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights=[9, 3, 6, 1, 2, 2, 1, 1, 1, 3, 3, 3, 3], k=rng.randint(0, 30)))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "..."), (None, "rare omega"), (None, "rare omega"), (403, "rare omega"), (403, "rare omega"), (404, "omega " * 50_000), (5, "another text with the id five")]
    items = [(1, "The rare omega, the"), (2, None), (3, "..."), (4, "nowhere"), (5, "a b c d x1 zeta"), (5, "a b c d x1 zeta"), (6, "中文 ünter"), (7, "of of of"), (None, "zeta"), (8, "rare"), (8, "omega")]
    d = spark.createDataFrame([(i, t, "q", 1) for i, t in docs], "doc_id int, text string, item_id string, score int").repartition(3)
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id int, text string, doc_id int")
    assert got(R.ranked(d, b)) == brute(docs, [x for x in items if x[1]], 10)
    assert got(R.ranked(d, b, k=500)) == brute(docs, [x for x in items if x[1]], 500)
    assert R.ranked(d.limit(0), b).collect() == [] and R.ranked(d, b.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, "!!"), (2, None)], "doc_id long, text string")
    assert R.ranked(odd, b).collect() == []
