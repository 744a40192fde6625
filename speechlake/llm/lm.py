"""Language-model scoring with a bigram trie in Elias-Fano form.

p(v | u) = (c(u v) + mu * p(v)) / (c(u) + mu), with p(v) = (c(v) + 1) / (N + V + 1); u of the first word is the end
mark. The trie holds what training pairs add to mu * p(v) / (c(u) + mu), as quantised log10 steps. It is cut into
shards by context (a frequent context by context and word), so it grows with the corpus and no process holds all of it.

Documents are read in batches. A batch sends its distinct words and its distinct pairs, with training counts, once
to each shard, and gets back counts, word numbers and codes for exactly these; repeats inside a batch never travel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import remainder, shuffle_partitions, stored
from speechlake.llm.elias_fano import Trie

MU = 300.0
#: Bytes of text in a batch.
BATCH_BYTES = 8 << 20


def pack_ints(a: np.ndarray) -> bytes:
    """Whole numbers from 0, narrow and by byte planes, compressed."""
    a = np.asarray(a)
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * w - (w == 8)))
    raw = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(3).compress(raw)


def unpack_ints(b: bytes) -> np.ndarray:
    width = b[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(3).compress(b"\n".join(words))


def unpack_words(b: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(b).split(b"\n")


def words_of(text: bytes) -> list[bytes]:
    """Words between the six ASCII blanks, A-Z in lower case."""
    return text.lower().split()


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def batches_of(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """batch, doc_ids, held, sizes, words, counts, tokens: texts as numbers of their batch's words; the end mark is the empty word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32

        def flush() -> pd.DataFrame:
            nonlocal number
            tokens = np.concatenate(parts)
            sizes = np.array([len(p) for p in parts], np.int64)
            counts = np.bincount(tokens[~np.repeat(np.array(held, bool), sizes)], minlength=len(index))
            row = {"batch": number, "doc_ids": ids, "held": held, "sizes": pack_ints(sizes), "words": pack_words(list(index)), "counts": pack_ints(counts), "tokens": pack_ints(tokens)}
            number += 1
            return pd.DataFrame({k: [v] for k, v in row.items()})

        index, ids, held, parts, size = _Index(), [], [], [], 0
        for pdf in batches:
            for i, h, text in zip(pdf["doc_id"].astype(object), pdf["held_out"], pdf["text"]):
                words = words_of(bytes(text))
                words.append(b"")
                parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                ids.append(None if pd.isna(i) else int(i))
                held.append(bool(h))
                size += len(text)
                if size >= batch_bytes:
                    yield flush()
                    index, ids, held, parts, size = _Index(), [], [], [], 0
        if parts:
            yield flush()

    return docs.mapInPandas(run, "batch long, doc_ids array<long>, held array<boolean>, sizes binary, words binary, counts binary, tokens binary")


def _shards(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in the order of their shards, and where each shard begins."""
    shard = np.fromiter((zlib.crc32(w) % n for w in words), np.int64, len(words))
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n + 1))


def word_counts(batches: DataFrame, n: int) -> DataFrame:
    """batch, shard, ids, counts of the batch's words of a shard; batch -1 has the shard's types and tokens."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for batch, raw, counts in zip(pdf["batch"], pdf["words"], pdf["counts"]):
                words, counts = unpack_words(raw), unpack_ints(counts)
                order, cut = _shards(words, n)
                rows = [(s, batch, pack_words([words[i] for i in order[a:b]]), pack_ints(counts[order[a:b]])) for s, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
                yield pd.DataFrame(rows, columns=["shard", "batch", "words", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_words(x) for x in pdf["words"]]
        total: dict[bytes, int] = {}
        for words, counts in zip(asked, pdf["counts"]):
            for w, c in zip(words, unpack_ints(counts).tolist()):
                total[w] = total.get(w, 0) + c
        shard = int(pdf["shard"].iloc[0])
        number = {w: i for i, w in enumerate(sorted(total))}
        rows = [(b, shard, pack_ints(np.array([number[w] for w in words]) * n + shard), pack_ints(np.array([total[w] for w in words])), 0, 0) for b, words in zip(pdf["batch"], asked)]
        rows.append((-1, shard, None, None, sum(c > 0 for c in total.values()), sum(total.values())))
        return pd.DataFrame(rows, columns=["batch", "shard", "ids", "counts", "types", "tokens"])

    sent = batches.select("batch", "words", "counts").mapInPandas(ask, "shard int, batch long, words binary, counts binary")
    return sent.groupBy("shard").applyInPandas(answer, "batch long, shard int, ids binary, counts binary, types long, tokens long")


class Batch:
    """A batch with the numbers and counts of its words, and its distinct pairs."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame, n: int, total: int, types: int, mu: float):
        self.sizes, self.tokens = unpack_ints(row["sizes"]), unpack_ints(row["tokens"])
        self.doc_ids, self.held = list(row["doc_ids"]), np.array(row["held"], bool)
        words = unpack_words(row["words"])
        order, _ = _shards(words, n)
        answers = answers.sort_values("shard")
        self.ids, self.c = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        self.ids[order] = np.concatenate([unpack_ints(x) for x in answers["ids"]])
        self.c[order] = np.concatenate([unpack_ints(x) for x in answers["counts"]])
        self.log_base = np.log10(self.c + 1.0) - np.log10(float(total + types + 1))
        end = words.index(b"")
        self.prev = np.concatenate([[end], self.tokens[:-1]])
        self.prev[np.cumsum(self.sizes)[:-1]] = end
        key, self.pair, counts = np.unique(self.prev * len(words) + self.tokens, return_inverse=True, return_counts=True)
        self.u, self.v = key // len(words), key % len(words)
        trained = np.repeat(~self.held, self.sizes)
        self.trained = np.bincount(self.pair[trained], minlength=len(key))
        # a context's pairs go to one shard; a context with more than a quarter of a shard's tokens is cut by its words
        pieces = np.maximum(1, np.ceil(4.0 * self.c[self.u] * n / max(1, total))).astype(np.int64)
        self.shard = (_spread(self.ids[self.u]) + _spread(self.ids[self.v]) % pieces) % n
        self.order = np.lexsort((self.ids[self.v], self.ids[self.u], self.shard))
        self.cut = np.searchsorted(self.shard[self.order], np.arange(n + 1))
        self.log_back = np.log10(mu / (self.c[self.u] + mu)) + self.log_base[self.v]

    def requests(self, batch: int) -> pd.DataFrame:
        rows = []
        for s, (a, b) in enumerate(zip(self.cut, self.cut[1:])):
            if a < b:
                i = self.order[a:b]
                u = self.ids[self.u[i]]
                rows.append((s, batch, pack_ints(np.diff(u, prepend=0)), pack_ints(self.ids[self.v[i]]), pack_ints(self.trained[i]), pack_ints(self.c[self.v[i]])))
        return pd.DataFrame(rows, columns=["shard", "batch", "u", "v", "n", "c"])

    def scores(self, answers: pd.DataFrame) -> pd.DataFrame:
        codes = np.zeros(len(self.u), np.int64)
        codes[self.order] = np.concatenate([unpack_ints(x) for x in answers.sort_values("shard")["codes"]])
        first = np.cumsum(self.sizes) - self.sizes
        by_doc = lambda x: np.add.reduceat(x, first)  # noqa: E731  every document has its end mark
        return pd.DataFrame({
            "doc_id": pd.array(self.doc_ids, "Int64"), "held_out": self.held, "n_tokens": self.sizes, "n_known": by_doc((self.c > 0).astype(np.int64)[self.tokens]),
            "base_score": by_doc(self.log_base[self.tokens]), "score": by_doc((self.log_back + codes * Trie.STEP)[self.pair]),
        })


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (y >> np.uint64(33)).astype(np.int64)


def trie_of(frame: pd.DataFrame, total: int, types: int, mu: float) -> tuple[Trie, list[tuple[np.ndarray, np.ndarray]]]:
    """A shard's trie from all batches' pairs, and the pairs of each batch."""
    asked = [(np.cumsum(unpack_ints(u)), unpack_ints(v)) for u, v in zip(frame["u"], frame["v"])]
    n = [unpack_ints(x) for x in frame["n"]]
    keep = [x > 0 for x in n]
    u, v = (np.concatenate([a[i][k] for a, k in zip(asked, keep)]) for i in (0, 1))
    n, c = (np.concatenate([x[k] for x, k in zip(xs, keep)]) for xs in (n, [unpack_ints(x) for x in frame["c"]]))
    order = np.lexsort((v, u))
    u, v, n, c = u[order], v[order], n[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])) if len(u) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, first) if len(u) else n
    gain = np.log10(1 + n * float(total + types + 1) / (mu * (c[first] + 1.0)))
    return Trie(Trie.pack(u[first], v[first], gain)), asked


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2, mu: float = MU, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null text is empty and scores its end mark. A null id is not held out. Repeated rows are learned from and scored
    each. Without training documents every count is 0. Other columns are ignored.
    """
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"))
    batches = stored(batches_of(rows, batch_bytes), "lm-batches")
    answers = stored(word_counts(batches, n), "lm-words")
    types, total = (int(x or 0) for x in answers.where("batch < 0").agg(F.sum("types"), F.sum("tokens")).first())
    answers = answers.where("batch >= 0").select("batch", "shard", "ids", "counts")

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return Batch(left.iloc[0], right, n, total, types, mu).requests(int(left["batch"].iloc[0]))

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        trie, asked = trie_of(frame, total, types, mu)
        return pd.DataFrame({"batch": frame["batch"], "shard": frame["shard"], "codes": [pack_ints(trie.look_up(u, v)) for u, v in asked]})

    def finish(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        words, codes = right[right["codes"].isna()], right[right["codes"].notna()]
        return Batch(left.iloc[0], words, n, total, types, mu).scores(codes).assign(train_tokens=total)

    by_batch = lambda df: df.groupBy("batch")
    pairs = by_batch(batches).cogroup(by_batch(answers)).applyInPandas(ask, "shard int, batch long, u binary, v binary, n binary, c binary")
    codes = pairs.groupBy("shard").applyInPandas(answer, "batch long, shard int, codes binary")
    back = answers.withColumn("codes", F.lit(None).cast("binary")).unionByName(codes.withColumns({"ids": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")}))
    return by_batch(batches).cogroup(by_batch(back)).applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
