import random

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from speechlake.llm import subword as S
from speechlake.llm.tokens import default_path

PATH = default_path("piece_bpe_32k.model")
V = S.vocabulary(PATH)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "Hello  world ", "a\n\nb\t c", "日本 \U0001f600 é ﬁ", "x\x00y", "     if x:\n        y", "aaaaaaaaaaaaaaaa", "<s> </s> <0x41>", "supercalifragilistic" * 30]


def one(text, dropout=0.0, seed=1, variant=0):
    return S.encode_texts(V, [text], [variant], seed, dropout)[0]


def test_without_dropout_equals_the_library():
    for t in TEXTS:
        assert one(t).tolist() == SP.encode(t), t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.sampled_from([0.0, 0.1, 0.5, 1.0]), st.integers(0, 5))
def test_decodes_losslessly(text, dropout, variant):
    if "\udc81" in text or any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert S.decode_ids(V, one(text, dropout, 7, variant)) == text


def test_rounds_equal_the_heap():
    rng = random.Random(5)
    chunks = ["".join(rng.choice("▁thenadiosr") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    keys = np.array([S.chunk_key(c, 3, 1) for c in chunks], np.uint64)
    limit = int(0.3 * 2**64)
    ids, n = S.by_rounds(V, chunks, keys, limit)
    got = np.split(ids, np.cumsum(n)[:-1])
    for c, k, g in zip(chunks, keys, got):
        assert g.tolist() == S.by_heap(V, c, int(k), limit), c


def test_traces_equal_the_heap():
    rng = random.Random(9)
    chunks, skips = [], []
    for _ in range(250):
        c = "".join(rng.choice("▁thenadiosr日") for _ in range(rng.randint(1, 24)))
        k: tuple = ()
        for _ in range(rng.randint(0, 3)):
            met = S.traced(V, c, k)[1]
            if met:
                k = (*k, (k[-1] + 1 if k else 0) + rng.randrange(len(met)))
        chunks.append(c)
        skips.append(k)
    ids, n, both, met = S.traced_all(V, chunks, skips)
    got, rows = np.split(ids, np.cumsum(n)[:-1]), np.split(both, np.cumsum(met)[:-1])
    for c, k, g, m in zip(chunks, skips, got, rows):
        assert (g.tolist(), [tuple(x) for x in m.tolist()]) == S.traced(V, c, k), (c, k)
    assert S.traced_all(V, [], [])[2].shape == (0, 2)


def test_varied_and_repeatable(spark):
    text = "the international transformation of organisations " * 20
    df = spark.createDataFrame([(i, text, "x") for i in range(40)] + [(None, None, "y"), (5, text, "z"), (99, "a▁b", "q")], "doc_id long, text string, variant string")
    out = S.encode(df, 0.3)
    rows = out.collect()
    by_variant = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id < 40:
            by_variant.setdefault(r.variant, set()).add(tuple(r.ids))
    assert all(len(x) == 1 for x in by_variant.values()) and len(set().union(*by_variant.values())) > 1
    assert sorted(map(str, rows)) == sorted(map(str, S.encode(df, 0.3).collect()))
    back = {r.doc_id: r.text for r in S.decode(out).collect()}
    assert back[3] == text and back[None] == "" and back[99] == "a▁b"
    assert all(r.lossless for r in S.encode(df, 0.3, digest=True).collect())
    assert S.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    share = {d: len(one(text, d)) for d in (0.0, 0.2, 1.0)}
    assert share[0.0] < share[0.2] < share[1.0] == len(text) + 1


def test_every_document_and_occurrence_is_sampled_on_its_own(spark):
    text = "transformation " * 60
    df = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string")
    rows = S.encode(df, 0.3).collect()
    assert len({tuple(r.ids) for r in rows}) == len({r.variant for r in rows}) == 60
    words, word = set(), []
    for i in rows[0].ids:
        if V.pieces[i].startswith(S.SPACE) and word:
            words.add(tuple(word))
            word = []
        word.append(i)
    assert len(words) > 5


def test_kept_candidates_equal_the_heap():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("thenadiosré日") for _ in range(rng.randint(1, 40))) for _ in range(60)) for _ in range(30)] * 2
    for dropout in (0.1, 0.2, 0.5):
        got = S.encode_texts(V, texts, list(range(len(texts))), 3, dropout)
        for variant, (text, ids) in enumerate(zip(texts, got)):
            key, want = np.array([S.document_key(3, variant)], np.uint64), []
            for nth, c in enumerate(S._CHUNK.findall(S.SPACE + text.replace(" ", S.SPACE))):
                own = int(S.mixed(key, np.array([nth]), np.array([0]))[0])
                x = np.array(S.by_heap(V, c, own, int(dropout * 2**64)), np.int64)
                want += S.with_bytes(V, x, np.array([len(x)]))[0].tolist()
            assert ids.tolist() == want
