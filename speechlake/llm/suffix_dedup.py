"""Removal of byte strings that have occurred before, by suffix sorting.

A string of MIN bytes belongs to the smallest hash among its GRAM-byte grams, which depends on the string alone. So
a document falls into runs of starts that share this hash (their anchor), about one for every 43 bytes, and equal
strings lie in runs with equal anchors. Runs whose anchor's gram occurs once hold no repeat. Of the others, runs with the
same bytes are one window each: all but its first occurrence are repeats throughout. The windows that share an anchor
and differ are cut out of the texts, and the suffixes at their starts are deep-shallow sorted to MIN bytes, each anchor
on its own; of equal ones all but the first are repeats. An anchor with very many starts is sorted in parts, and the
parts' firsts are matched by a 128-bit digest. Windows are matched by 128 bits of hash as well (anchor and window).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import keyed, stored, trimmed
from speechlake.llm.suffix_sort import deep_shallow_sort, words_at

MIN, GRAM = 100, 16
#: Starts of one anchor that are sorted together, suffixes that are sorted at once, and the most starts of a run; longer
#: runs, which only texts with a short period have, are cut.
PART, BLOCK, LONGEST = 300_000, 150_000, 1_024
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
_A, _B, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93
_INVERSE = pow(_R, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x, have = best(x[:-have], x[have:]), 2 * have
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Anchors:
    """Runs of starts with one anchor, for documents laid end to end."""

    def __init__(self, least: int = MIN, gram: int = GRAM):
        self.least, self.gram, self.up, self.down = least, gram, _powers(_R, 1), _powers(_INVERSE, 1)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of each run: the text's number, first start, number of starts, anchor, window hash, and whether the anchor's gram occurs again in it."""
        size = np.array([len(t) for t in texts], np.int64)
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        if len(buffer) < self.least:
            return (np.zeros(0, np.int64),) * 6
        if len(self.up) < len(buffer) + 1:
            self.up, self.down = _powers(_R, len(buffer) + 1), _powers(_INVERSE, len(buffer) + 1)
        with np.errstate(over="ignore"):
            eight = _mix(words_at(buffer))
            gram = eight[: -self.gram + 8] * _A + eight[self.gram - 8 :] * _B
            gram = _mix(gram)
            want = self.least - self.gram + 1
            low = _sliding(gram, want, np.minimum)
            begin = np.cumsum(size) - size
            valid = np.zeros(len(low) + 1, np.int8)
            have = size >= self.least
            np.add.at(valid, begin[have], 1)
            np.add.at(valid, (begin + size - self.least + 1)[have], -1)
            ok = np.cumsum(valid[:-1]) > 0
            head = np.ones(len(low), bool)
            head[1:] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
            inner = begin[(begin > 0) & (begin < len(low))]
            head[inner] = True
            # grams that are the smallest of some window; two equal ones that follow each other closely repeat in one run
            none = np.zeros(want - 1, np.uint64)
            top = np.flatnonzero(gram == _sliding(np.concatenate([none, np.where(ok, low, np.uint64(0)), none]), want, np.maximum))
            twice = np.flatnonzero((gram[top[1:]] == gram[top[:-1]]) & (top[1:] - top[:-1] <= want))
            again = np.zeros(len(low), bool)
            again[np.maximum(top[twice + 1] - want + 1, begin[np.searchsorted(begin, top[twice + 1], "right") - 1])] = True
            first = np.flatnonzero(head)
            again = np.logical_or.reduceat(again, first)
            count = np.diff(np.append(first, len(low)))
            keep = ok[first]
            first, count, again = first[keep], count[keep], again[keep]
            pieces = -(-count // LONGEST)
            inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, again = np.repeat(first, pieces) + inside * LONGEST, np.repeat(again, pieces)
            count = np.minimum(np.repeat(count, pieces) - inside * LONGEST, LONGEST)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(eight * self.up[: len(eight)], dtype=np.uint64)])
            window = (sums[first + count + self.least - 8] - sums[first]) * self.down[first]
        owner = np.searchsorted(begin, first, "right") - 1
        return owner, first - begin[owner], count, low[first].view(np.int64), window.view(np.int64), again


def runs_of(rows: DataFrame, only_anchors: bool = False) -> DataFrame:
    """anchor, window, doc_id, run of all runs of a table (doc_id, text as bytes).

    run holds the first start, the number of starts, and whether the anchor's gram occurs again. With only_anchors,
    just the anchors, those that occur again twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors()

        def frame(ids: list, texts: list[bytes]) -> pd.DataFrame:
            owner, first, count, anchor, window, again = anchors(texts)
            if only_anchors:
                return pd.DataFrame({"anchor": np.concatenate([anchor, anchor[again]])})
            return pd.DataFrame({"anchor": anchor, "window": window, "doc_id": np.array(ids, np.int64)[owner], "run": (first << 31 | count) << 1 | again})

        for pdf in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                if len(t) < MIN:
                    continue
                ids.append(i)
                texts.append(bytes(t))
                size += len(t)
                if size >= CHUNK:
                    yield frame(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield frame(ids, texts)

    return rows.mapInPandas(trimmed(run), "anchor long" if only_anchors else "anchor long, window long, doc_id long, run long")


def sorted_repeats(windows: DataFrame) -> DataFrame:
    """From (anchor, part, parts, doc_id, start, n, bytes): repeats found by suffix sorting, and the firsts of anchors in parts.

    kind 0: n starts from ``start`` repeat. kind 1: firsts of strings in a part of a large anchor, as packed rows of
    digest, document and start; bucket is the digest's, of as many as the anchor has parts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, last = 0, None
        for pdf in batches:
            for row in zip(pdf["anchor"], pdf["part"], pdf["parts"], pdf["doc_id"], pdf["start"], pdf["n"], pdf["bytes"]):
                if size >= BLOCK and row[:2] != last:
                    yield _repeats(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + row[5], row[:2]
        if held:
            yield _repeats(held)

    dealt = windows.repartition(F.col("anchor"), F.col("part")).sortWithinPartitions("anchor", "part")
    return dealt.mapInPandas(trimmed(run), "kind int, anchor long, bucket long, doc_id long, start long, n long, firsts binary")


def _repeats(rows: list[tuple]) -> pd.DataFrame:
    n = np.array([r[5] for r in rows], np.int64)
    size = np.array([len(r[6]) for r in rows], np.int64)
    buffer = np.frombuffer(b"".join(bytes(r[6]) for r in rows), np.uint8)
    owner = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[owner] + inside
    doc, start = np.array([r[3] for r in rows], np.int64)[owner], np.array([r[4] for r in rows], np.int64)[owner] + inside
    piece = np.cumsum([False] + [r[:2] != q[:2] for q, r in zip(rows, rows[1:])])
    order, group = deep_shallow_sort(buffer, at, MIN, group=piece[owner])
    place = np.empty(len(at), np.int64)  # among all starts by document and position
    place[np.lexsort((start, doc))] = np.arange(len(at))
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = np.minimum.reduceat(place[order], head)
    again = place[order] != np.repeat(first, np.diff(np.append(head, len(order))))
    hit = order[again]
    hit = hit[np.lexsort((start[hit], doc[hit]))]
    d, s = doc[hit], start[hit]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])[: len(hit)]
    begin = np.flatnonzero(new)
    out = pd.DataFrame({"kind": 0, "anchor": 0, "bucket": 0, "doc_id": d[begin], "start": s[begin], "n": np.diff(np.append(begin, len(hit))), "firsts": None})
    cut = np.array([r[2] > 1 for r in rows])
    if cut.any():
        lone = order[~again]
        lone = lone[cut[owner[lone]]]
        raw = buffer.tobytes()
        digest = np.array([divmod(xxhash.xxh3_128_intdigest(raw[a : a + MIN]), 1 << 64) for a in at[lone].tolist()], np.uint64).reshape(-1, 2)
        anchor, parts = (np.array([r[i] for r in rows], np.int64)[owner[lone]] for i in (0, 2))
        bucket = (digest[:, 0] % parts.astype(np.uint64)).astype(np.int64)
        firsts = np.stack([digest[:, 0].view(np.int64), digest[:, 1].view(np.int64), doc[lone], start[lone]], axis=1)
        by = np.lexsort((bucket, anchor))
        anchor, bucket, firsts = anchor[by], bucket[by], firsts[by]
        cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (bucket[1:] != bucket[:-1])) + 1
        head = np.concatenate([[0], cuts]) if len(by) else np.zeros(0, np.int64)
        more = pd.DataFrame({"kind": 1, "anchor": anchor[head], "bucket": bucket[head], "doc_id": 0, "start": 0, "n": 0, "firsts": [x.tobytes() for x in np.split(firsts, cuts)][: len(head)]})
        out = pd.concat([out, more])
    return out


def repeated_starts(rows: DataFrame) -> DataFrame:
    """doc_id, start, n: starts whose MIN bytes also start earlier, for a table of distinct doc_id with text as bytes."""
    runs = runs_of(rows)
    often = stored(runs_of(rows, True).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "suffix-anchors")
    shared = stored(runs.join(often, "anchor"), "suffix-runs")
    first = shared.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "run")).alias("first"), F.count("*").alias("c"))
    first = stored(first.select("anchor", "window", F.col("first.doc_id").alias("first_id"), F.col("first.run").alias("first_run"), "c"), "suffix-windows")
    whole = shared.join(first.where("c > 1"), ["anchor", "window"]).where("doc_id != first_id or run != first_run")
    start, count = F.shiftright("run", 32), F.shiftright("run", 1).bitwiseAND(F.lit((1 << 31) - 1))
    whole = whole.select("doc_id", start.alias("start"), count.alias("n"))
    mixed = stored(first.groupBy("anchor").agg(F.count("*").alias("windows"), F.sum(F.shiftright("first_run", 1).bitwiseAND(F.lit((1 << 31) - 1))).alias("starts"), F.max(F.col("first_run").bitwiseAND(F.lit(1))).alias("again")).where("windows > 1 or again > 0"), "suffix-mixed")
    parts = F.ceil(F.col("starts") / PART).cast("int")
    differing = first.join(mixed, "anchor").select("anchor", parts.alias("parts"), F.pmod(F.xxhash64("first_id", "first_run"), parts).cast("int").alias("part"), F.col("first_id").alias("doc_id"), F.col("first_run").alias("run"))
    wanted = differing.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "parts", "part", start.alias("start"), count.alias("n"))).alias("wanted"))

    names = ["anchor", "parts", "part", "start", "n"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                some = pdf.iloc[lo : lo + 512]
                out = {c: np.concatenate(some[c].to_numpy()) for c in names}
                pieces = []
                for text, starts, counts in zip(some["text"], some["start"], some["n"]):
                    text = bytes(text)
                    pieces += [text[s : s + n + MIN - 1] for s, n in zip(starts.tolist(), counts.tolist())]
                yield pd.DataFrame(out | {"doc_id": np.repeat(some["doc_id"].to_numpy(), [len(x) for x in some["start"]]), "bytes": pieces})

    lists = rows.join(wanted, "doc_id").select("doc_id", "text", *[F.col(f"wanted.{c}").alias(c) for c in names])
    pieces = lists.mapInPandas(trimmed(cut), "anchor long, parts int, part int, start long, n long, doc_id long, bytes binary")
    found = stored(sorted_repeats(pieces), "suffix-sorted")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(bytes(x) for x in pdf["firsts"]), np.int64).reshape(-1, 4)
        rows = rows[np.lexsort(rows.T[::-1])]
        late = rows[1:][(rows[1:, :2] == rows[:-1, :2]).all(1)]
        late = late[np.lexsort((late[:, 3], late[:, 2]))]
        doc, start = late[:, 2], late[:, 3]
        begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])[: len(late)])
        return pd.DataFrame({"doc_id": doc[begin], "start": start[begin], "n": np.diff(np.append(begin, len(late)))})

    late = found.where("kind = 1").groupBy("anchor", "bucket").applyInPandas(meet, "doc_id long, start long, n long")
    return whole.unionByName(found.where("kind = 0").select("doc_id", "start", "n")).unionByName(late.select("doc_id", "start", "n"))


def covered(starts: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Union of the bytes of all repeated strings, as maximal runs."""
    out: list[list[int]] = []
    for a, n in sorted(zip(starts, counts)):
        b = a + n + MIN - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_bytes, n_removed, spans (start and end of maximal removed runs), kept (the remaining bytes) for every document.

    A null text is empty. Rows equal in id and text are one document; rows that share an id but not the text are
    documents of their own, as are rows without an id, which come last. Texts below MIN bytes stay whole. Earlier means a
    smaller key (see common.keyed), or an earlier start in the same text. Other columns are ignored.
    """
    rows = keyed(docs)
    texts = rows.select(F.col("key").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spans = repeated_starts(texts).groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("start", "n")).alias("hits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, starts, counts in zip(pdf["text"], pdf["start"], pdf["n"]):
                text = bytes(text)
                found = covered(starts.tolist(), counts.tolist()) if starts is not None else []
                ends = [0, *(x for s in found for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
                out.append((len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in found], kept))
            yield pd.concat([pdf[["key", "mark", "id"]], pd.DataFrame(out, columns=["n_bytes", "n_removed", "spans", "kept"], index=pdf.index)], axis=1)

    joined = rows.join(spans, "key", "left").select("key", "mark", F.col("doc_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"), "hits.start", "hits.n")
    found = joined.mapInPandas(trimmed(run), "key long, mark binary, id string, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return found.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", "doc_id")


def without_repeats(docs: DataFrame) -> DataFrame:
    """mark, text: what remains of the texts, by the marks of their documents (see common.mark_of). A character that is removed in part goes as a whole; a text may become empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"mark": pdf["mark"], "text": [bytes(x).decode("utf-8", "ignore") for x in pdf["kept"]]})

    return remove_repeats(docs).select("mark", "kept").mapInPandas(trimmed(run), "mark binary, text string")


def digest_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
