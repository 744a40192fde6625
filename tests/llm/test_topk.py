import math
import random

import numpy as np

from speechlake.llm import topk as K


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in ok if i % every == 0}):
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    hot = [rng.gauss(0, 0.3) for _ in range(8)]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(700)]
    rows += [(700, None), (750, [None] + hot[1:]), (800, [float("nan")] + hot[1:]), (850, [float("inf")] + hot[1:]), (900, [1.0, 2.0]), (901, [0.5, 0.5]), (950, []), (None, hot), (7, hot)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    want = brute(rows)
    for shard, block in ((K.SHARD, K.QUERY_BLOCK), (90, 4)):
        assert sorted(tuple(r) for r in K.top_k(df, shard=shard, block=block).collect()) == want


def test_tree_skips_pages_and_stays_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (20, 4))
    vecs = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(0, 5, (3000, 4))).astype(np.int64)
    tree = K.MTree(np.arange(3000), vecs, int((vecs**2).sum(1).max()), leaf=32, fan=4)
    for q in range(0, 3000, 97):
        scores = vecs @ vecs[q]
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        assert tree.search(vecs[q], q, 5) == [(-s, i) for s, i in want]


def test_large_components_and_empty(spark):
    df = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [-3e6, 2.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in K.top_k(df).orderBy("rank").collect()]
    a = [768000000, 256]
    assert got == [(1, a[0] * a[0] + 256 * 512), (2, -a[0] * a[0] + 256 * 512)]
    assert K.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
