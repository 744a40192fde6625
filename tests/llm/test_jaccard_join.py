import random
import re
from collections import Counter

import pytest

from speechlake.llm import jaccard_join as J
from speechlake.llm.components import components


def brute(rows, percent=85):
    texts = sorted({(i is None, i or 0, t or "") for i, t in rows})
    sets = []
    for _, _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    name = lambda i: None if texts[i][0] else texts[i][1]
    return Counter((name(i), len(sets[i]), name(find(i))) for i in range(len(sets)))


def made(rng, n=260):
    word = lambda: rng.choice("abcdefghijklmnopq") + rng.choice("aeiou") + rng.choice("xyz")
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.65:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                kind, at = rng.random(), rng.randrange(len(w) + 1)
                if kind < 0.4:
                    w.insert(at, word())
                elif at < len(w):
                    w[at : at + 1] = [] if kind < 0.7 else [word()]
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.uniform(0.8, 1))] or ["a"]
        else:
            w = [word() for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 12, 20, 30, 60, 150, 500]))]
        rows.append((7 * i % 1009, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, ""), (2004, rows[0][1].upper()), (2005, "one two"), (2006, "ONE\ttwo"), (2007, "one two three"), (2000, "not empty"), (None, rows[1][1]), (None, rows[1][1]), (None, "alone in this world it stands"), (7, rows[1][1]), (2009, "long text " * 60_000 + "x"), (2010, "long text " * 60_000 + "y")]
    rows += [(3000 + k, "same words " * 40 + f"tail{k}") for k in range(25)] + [(4000 + k, " ".join(f"g{x}" for x in range(90)) + f" end{k} end{k % 3}") for k in range(40)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(J, "BATCH_BYTES", 9000)
    monkeypatch.setattr(J, "BLOCK", 1024 if seed == 1 else 5)
    rows = made(random.Random(seed))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect())
    want = brute(rows)
    assert got - want == Counter() and want - got == Counter()


def test_signatures_meet_for_every_close_pair():
    rng = random.Random(11)
    bands = J.Bands()
    for trial in range(400):
        n = rng.choice([6, 7, 8, 9, 13, 20, 31, 40, 77, 200, 400])
        a = [rng.getrandbits(64) for _ in range(n)]
        b = list(a)
        while True:
            c = list(b)
            if rng.random() < 0.5 and len(c) > 1:
                c.pop(rng.randrange(len(c)))
            else:
                c.append(rng.getrandbits(64))
            both = len(set(a) & set(c))
            if 100 * both < 85 * (len(a) + len(c) - both) or rng.random() < 0.02:
                break
            b = c
        import numpy as np

        sig, own = J.signatures([np.unique(np.array(a, np.uint64)), np.unique(np.array(b, np.uint64))], bands)
        assert set(a) == set(b) or set(sig[own == 0]) & set(sig[own == 1]), (len(a), len(b))


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[90], got[95], got[100]} == {90}


def test_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
