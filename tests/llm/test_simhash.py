import hashlib
import random
import re

import xxhash

from speechlake.llm import simhash as S


def brute_print(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    votes = [0] * 64
    for i in range(len(w)):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    rows = [(3 * i + 1, " ".join(word() for _ in range(rng.randint(0, 80))) + rng.choice(["", "\n", " \t"])) for i in range(60)]
    rows += [(500, None), (501, ""), (502, rows[3][1]), (503, "x" * 5000), (504, "\U0001f600é " * 9)]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows] + [(502, rows[3][1], "c", 1)], "doc_id long, text string, fingerprint string, n_chars int")
    got = {r.doc_id: r for r in S.document_fingerprints(df).collect()}
    order = sorted(rows)
    assert sorted(got) == [i for i, _ in order]
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt, r = t or "", nxt or "", got[i]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = brute_print(t), brute_print(edited), brute_print(nxt)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f"{a:016x}", f"{b:016x}")
        assert abs(r.near_edited - (1 - (a ^ b).bit_count() / 64)) < 1e-12 and abs(r.near_next - (1 - (a ^ c).bit_count() / 64)) < 1e-12


def test_one_document_and_none(spark):
    schema = "doc_id long, text string"
    assert S.document_fingerprints(spark.createDataFrame([], schema)).collect() == []
    (r,) = S.document_fingerprints(spark.createDataFrame([(7, "a b c d e f g h")], schema)).collect()
    assert r.near_next == 1.0


def test_block_tables_find_all_pairs(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = base + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for x in base for _ in range(4)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints] + [(None,), (signed(prints[0]),)], "fingerprint long")
    for radius in (0, 1, 3):
        want = {(signed(a), signed(b), (a ^ b).bit_count()) for a in base for b in set(prints) if (a ^ b).bit_count() <= radius}
        got = S.within_radius(df.where(F_in(base, signed)), df, radius).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def F_in(values, signed):
    from pyspark.sql import functions as F

    return F.col("fingerprint").isin([signed(v) for v in values])


def test_neighbours_are_classes_of_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(12)]
    rows = [(10 * k + j, " ".join(w[: 120 - j // 3])) for k, w in enumerate(base) for j in range(9)] + [(5, None), (None, "x"), (7, "a b"), (7, "a b"), (7, "a c")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, distance int")
    prints = {(i, brute_print(t or "")) for i, t in set(rows)}
    classes = {p: (min((i for i, q in prints if q == p and i is not None), default=None), len({x for x in set(rows) if brute_print(x[1] or "") == p})) for _, p in prints}
    want = {(i, f"{p:016x}", *classes[q], (p ^ q).bit_count()) for i, p in prints if i is not None and i % 2 == 0 for q in classes if (p ^ q).bit_count() <= 3}
    from pyspark.sql import functions as F

    got = S.neighbours(df, F.col("doc_id") % 2 == 0).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r.class_size > 1 for r in got) > 3


def test_rows_of_one_id_and_without_one(spark):
    rows = [(1, "a b c d e f"), (1, "other text of it"), (None, "no id"), (1, "a b c d e f")]
    got = S.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
    assert {r.fingerprint for r in got} == {f"{brute_print(t):016x}" for _, t in rows}


def test_a_text_is_sent_to_its_neighbour_once(spark, monkeypatch):
    plans, store = {}, S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and store(df, name))
    df = spark.createDataFrame([(i, f"a b c d {i}") for i in range(5)], "doc_id long, text string")
    assert len(S.document_fingerprints(df).collect()) == 5
    assert len(re.findall(r"\bExchange ", plans["simhash-prints"])) == 2  # the texts, and the beginnings that go before them
