import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from speechlake.llm import suffix_dedup as D
from speechlake.llm import suffix_sort as S


def test_deep_shallow_sort_orders_suffixes():
    rng = random.Random(1)
    for depth, shallow, letters in ((100, 24, "ab"), (30, 8, "abc"), (9, 24, "ab"), (100, 24, "a"), (17, 0, "ab")):
        text = "".join(rng.choice(letters) for _ in range(600)).encode()
        text = text + text[100:400] + bytes([255, 0] * 90) + b"\xff" * 150
        starts = np.array(rng.sample(range(len(text) - depth), 500), np.int64)
        order, group = S.deep_shallow_sort(np.frombuffer(text, np.uint8), starts, depth, shallow)
        got = [text[starts[i] : starts[i] + depth] for i in order]
        assert got == sorted(got)
        assert all((group[i] == group[i + 1]) == (got[i] == got[i + 1]) for i in range(len(got) - 1))
        own = np.array([rng.randrange(5) for _ in starts])
        order, group = S.deep_shallow_sort(np.frombuffer(text, np.uint8), starts, depth, shallow, own)
        got = [(own[i], text[starts[i] : starts[i] + depth]) for i in order]
        assert got == sorted(got)
        assert all((group[i] == group[i + 1]) == (got[i] == got[i + 1]) for i in range(len(got) - 1))


def test_sort_of_many_equal_and_of_sorted_suffixes():
    rows = np.frombuffer(b"".join(b"%016d" % (i // 3) for i in range(9000)), np.uint8)
    starts = np.arange(0, len(rows), 16)
    order, group = S.deep_shallow_sort(rows, starts, 16, 8)
    assert (order // 3 == np.arange(9000) // 3).all() and (group == np.arange(9000) // 3).all()


def brute(rows):
    seen, out = set(), Counter()
    mark_of = lambda i, t: hashlib.md5(f"{'none' if i is None else i}:{t}".encode()).digest()
    for none, i, _, t in sorted({(i is None, i or 0, mark_of(i, t or ""), t or "") for i, t in rows}):
        raw = t.encode()
        mark = bytearray(len(raw))
        for a in range(len(raw) - 99):
            s = raw[a : a + 100]
            if s in seen:
                mark[a : a + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        spans = sum(m and not p for m, p in zip(mark, b"\0" + mark))
        out[None if none else i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def made(rng):
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(60), text(12), "x" * 100, text(30)]
    rows = []
    for i in range(150):
        parts = [text(rng.randint(0, 60)) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passage))
        rows.append((3 * i, " ".join(parts)))
    rows += [(1000 + k, rows[k][1]) for k in range(20)]  # copies
    for k in range(20, 50):  # near copies
        w = rows[k][1].split(" ")
        w[rng.randrange(len(w))] = word()
        rows.append((1000 + k, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "a" * 1000), (5003, "a" * 99), (5004, "ab" * 400), (5005, "a" * 100), (5006, text(4000) + passage[0]), (5007, "q" * 100), (5008, "q" * 101)]
    rows += [(5000, "same id"), (None, passage[0]), (6, rows[2][1] + " longer"), (-4, passage[0] * 3)]
    return rows


@pytest.mark.parametrize("part", [D.PART, 130])
def test_matches_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(D, "PART", part)
    monkeypatch.setattr(D, "BLOCK", 500)
    rows = made(random.Random(7))
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.digest_of(df).collect())
    want = brute(rows)
    assert got - want == Counter() and want - got == Counter()


def test_long_texts_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 3000)
    monkeypatch.setattr(D, "LONGEST", 50)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdef ") for _ in range(9000))
    rows = [(1, text), (2, text[4000:8000] + "z" + text[:4000]), (3, "a" * 5000), (4, "ab" * 3000 + text[100:300]), (5, "a" * 700)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.digest_of(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert D.digest_of(spark.createDataFrame([], "doc_id long, text string")).collect() == []
