import hashlib
import random

import numpy as np
import pytest

from speechlake.llm import byte_bpe as B
from speechlake.llm.tokens import default_path, fast_encoder

PATHS = [default_path("byte_bpe_50k.tiktoken"), default_path("byte_bpe_multi_50k.tiktoken")]


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers

    return B.ByteBpe(PATHS[0], public_tokenizers.PATTERN), fast_encoder(PATHS[0])


def ids(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


@pytest.mark.parametrize("path", PATHS)
def test_every_entry_of_a_vocabulary_is_its_own_encoding(path):
    import public_tokenizers

    coder = B.ByteBpe(path, public_tokenizers.PATTERN)
    mapped = [e.decode("latin-1").translate(coder.chars) for e in coder.raw]
    got = coder.model.encode(mapped, num_threads=1)
    assert [x for x in zip(coder.raw, got, range(len(got))) if x[1] != [x[2]]] == []
    assert coder.model.get_piece_size() == len(coder.raw) + 1 and len(set(B.byte_characters())) == 256


def test_every_character_splits_and_encodes_as_in_the_library(pair):
    coder, library = pair
    wrong = []
    for lo in [*range(0, 0x32000, 64), *range(0xE0000, 0xE0200, 64)]:  # the rest is unassigned or private
        chars = [chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}{c} {c}!{c}  {c}\n" for c in chars)
        if ids(coder, text) != library.encode_ordinary(text):
            wrong.append(lo)
    assert wrong == []


def test_random_and_hard_texts_match_the_library_and_come_back(pair):
    coder, library = pair
    rng = random.Random(13)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "中文", "क्षि", "🙂", "👩‍👩‍👧", "'s", "'ll", "1", "23", "!", "...", " ", "　", "\x00", "\x1c", "\x85", "<|endoftext|>", "﻿", "Ω", "ß"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "\n\n\n  x", "a" * 20_000, "ab" * 20_000, "é" * 10_000, " " * 30_000, "word " * 300_000, "".join(chr(rng.randrange(0x20, 0x3000)) for _ in range(50_000))]
    for t in texts:
        got = ids(coder, t)
        assert got == library.encode_ordinary(t)
        assert coder.decode(np.array(got, np.int64)) == t.encode()
    with pytest.raises(ValueError):
        coder.decode(np.array([len(coder.raw)]))


def test_what_is_kept_stays_bounded(pair, monkeypatch):
    coder, library = pair
    monkeypatch.setattr(B, "MOST", 50)
    monkeypatch.setattr(B, "WINDOW", 20)
    rng = random.Random(1)
    for _ in range(20):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 70))) for _ in range(100))
        assert ids(coder, text) == library.encode_ordinary(text)
        assert len(coder.kept) <= 50 + 20


def test_rows_of_every_kind(spark):
    docs = [(1, "Some words, twice. Some words."), (2, None), (3, ""), (None, "no id"), (1, "Some words, twice. Some words."), (4, "long " * 200_000)]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id int, text string, ids string, n_tokens int")
    want = []
    for i, t in docs:
        x = np.array(fast_encoder(PATHS[0]).encode_ordinary(t or ""), "<u4")
        want.append((i or -1, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digest_of(df).collect()]
    assert sorted(got) == sorted(want)
    back = [(r.doc_id or -1, bytes(r.bytes).decode()) for r in B.decode(B.encode(df)).collect()]
    assert sorted(back) == sorted((i or -1, t or "") for i, t in docs)
    assert B.digest_of(df.limit(0)).collect() == [] and B.decode(B.encode(df.limit(0))).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert B.decode(none).first().bytes is None
