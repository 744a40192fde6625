import random

import numpy as np

from speechlake.llm import token_counts as C
from speechlake.llm.tokens import encode_plain, json_tokenizer, default_path


def brute(ids, eod):
    out, n = [], 0
    for i in ids:
        if i == eod:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


def test_blocks_of_any_size_match_a_plain_walk(spark):
    rng = random.Random(8)
    files = {f"f{k}": [9 if rng.random() < rng.choice([0.02, 0.5]) else rng.randrange(9) for _ in range(rng.randint(0, 300))] for k in range(12)}
    files |= {"none": [1] * 77, "ends": [9] * 20, "one": [9]}
    want = sorted((f, i, n, c) for f, ids in files.items() for i, (n, c) in enumerate(brute(ids, 9)))
    for size in (2, 6, 64, 1000):
        rows = [(f, b // size, raw[b : b + size]) for f, ids in files.items() for raw in [np.array(ids, "<u2").tobytes()] for b in range(0, len(raw), size)]
        rows.append(("null", 0, None))
        df = spark.createDataFrame(rows, "file string, block long, data binary")
        assert sorted(tuple(r) for r in C.count_tokens(df, eod=9).collect()) == want


def test_documents_and_flat_files(spark, tmp_path):
    docs = [(i, "some words here " * (i % 30)) for i in range(150)] + [(500, None), (501, ""), (None, "x y"), (7, "again and again"), (600, "a<|endoftext|>b " * 3), (601, "long " * 60000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, block int")
    got = sorted((r.doc_id or -1, r.n_tokens) for r in C.document_tokens(df).collect())
    assert got == sorted((i or -1, len(encode_plain(t or ""))) for i, t in docs)
    assert C.document_tokens(df.limit(0)).collect() == []
    (tmp_path / "a.bin").write_bytes(np.array([5, 6, C.EOD, 7, C.EOD], "<u2").tobytes())
    got = C.count_tokens(C.read_flat(spark, f"file://{tmp_path}", 4)).collect()
    assert sorted((r.ordinal, r.n_tokens, r.closed) for r in got) == [(0, 2, True), (1, 1, True)]


def test_the_end_of_text_string_counts_as_text():
    tok = json_tokenizer.__wrapped__(default_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    for t in ("a<|endoftext|>b", "<|endoftext|>", "plain", ""):
        ids = encode_plain(t)
        assert ids == tok.encode(t, add_special_tokens=False).ids and C.EOD not in ids
