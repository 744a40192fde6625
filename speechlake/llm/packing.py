"""Mixture-controlled packing.

Every source is a queue of tokens with a target share of every window. Deficit round-robin gives a queue, window after
window, the tokens that its share has earned since its last service; what it is owed is carried on to the next window,
and a queue that runs dry releases its share to the others. Served in the order in which tokens are earned, the state
before window k has a closed form: at virtual time v a queue of n tokens and weight w has earned min(n, w * v), token
x of it is due when w * v reaches x - 1/2, and the first k * length tokens by due time are those served. So a task works out
the deficits of any window by itself, and windows, partitions and documents need no common walk. By default the
targets are the sources' parts of all tokens, so that all queues run dry together and nothing is left over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlake.llm.common import stored
from speechlake.llm.tokens import encode

LENGTH = 2048
END = 1
#: Sources are told apart up to so many; of more, each goes to one of so many queues by its hash.
MAX_QUEUES = 4096
#: Where tasks' parts of the queues begin is broadcast up to so many rows, and joined beyond.
BROADCAST_ROWS = 200_000


class Mixture:
    """Cut points of every queue, given the number of tokens in each and their weights (their parts of all tokens, if not given)."""

    def __init__(self, totals: np.ndarray, length: int = LENGTH, weights: np.ndarray | None = None):
        self.n, self.length = np.asarray(totals, np.int64), length
        self.total = int(self.n.sum())
        self.windows = self.total // length
        own = self.n.astype(np.float64) / max(1, self.total)
        if weights is None:
            self.share = own
        else:
            self.share = np.asarray(weights, np.float64) / np.sum(weights, initial=0.0)
        # queues by the virtual time at which they run dry, and what all have earned by then
        dry = np.divide(self.n, self.share, out=np.zeros(len(self.n)), where=self.share > 0)
        order = np.argsort(dry, kind="stable")
        self.dry_at = dry[order]
        live = np.concatenate([np.cumsum(self.share[order][::-1])[::-1], [0.0]])
        self.live = live
        self.earned_at = np.concatenate([[0.0], np.cumsum(np.diff(self.dry_at, prepend=0.0) * live[:-1])])
        full = self.served(np.array([self.windows]))[0]
        self.rest_from = full
        self.rest_at = np.concatenate([[0], np.cumsum(self.n - full)])
        rest, sizes = self.total - self.windows * length, []
        while rest:
            sizes.append(1 << (rest.bit_length() - 1))
            rest -= sizes[-1]
        self.rest_cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def earned(self, v: np.ndarray) -> np.ndarray:
        """Tokens that all queues have earned by virtual time v."""
        i = np.searchsorted(self.dry_at, v, "right")
        return self.earned_at[i] + (v - np.concatenate([[0.0], self.dry_at])[i]) * self.live[i]

    def reached(self, t: np.ndarray) -> np.ndarray:
        """The virtual time at which all queues have earned t tokens."""
        i = np.clip(np.searchsorted(self.earned_at, t, "right") - 1, 0, len(self.dry_at) - 1)
        return np.concatenate([[0.0], self.dry_at])[i] + (t - self.earned_at[i]) / np.maximum(self.live[i], 1e-300)

    def _due(self, v: np.ndarray) -> np.ndarray:
        """Tokens of each queue that are due by virtual time v."""
        return np.minimum(np.floor(np.maximum(v, 0)[:, None] * self.share + 0.5).astype(np.int64), self.n)

    def served(self, k: np.ndarray) -> np.ndarray:
        """Tokens of each queue in the windows before window k: a row for each k."""
        k = np.asarray(k, np.int64)
        if not len(self.n):
            return np.zeros((len(k), 0), np.int64)
        want = k * self.length
        lo = self.reached(np.maximum(want - len(self.n) - 2, 0).astype(np.float64)) - 1e-9
        lo = np.where(self._due(lo).sum(1) >= want, -1.0, lo)
        hi = np.full(len(k), self.dry_at[-1] + 1.0)
        near = self.reached(np.minimum(want + len(self.n) + 2, self.total).astype(np.float64)) + 1e-9
        hi = np.where(self._due(near).sum(1) >= want, near, hi)
        for _ in range(64):
            mid = (lo + hi) / 2
            enough = self._due(mid).sum(1) >= want
            lo, hi = np.where(enough, lo, mid), np.where(enough, mid, hi)
        before, after = self._due(lo), self._due(hi)
        # tokens due at the same moment: the first queues come first
        ties = after - before
        left = (want - before.sum(1))[:, None] - (np.cumsum(ties, 1) - ties)
        return np.where((k >= self.windows)[:, None] & (want >= self.total)[:, None], self.n, before + np.clip(left, 0, ties))

    def deficits(self, k: np.ndarray) -> np.ndarray:
        """What each queue has earned before window k and not been served: the deficits that are carried on."""
        k = np.asarray(k, np.int64)
        return np.minimum(self.reached((k * self.length).astype(np.float64))[:, None] * self.share, self.n) - self.served(k)

    def pieces(self, queue: int, start: int, end: int, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of tokens [start, end) of a queue: their starts, sequence ids and offsets in the sequence."""
        starts, seqs, offs = [], [], []
        split = int(self.rest_from[queue])
        if start < split:
            # the windows of the first and last of these tokens, as far as rounding may move them
            v = np.array([max(0, start - 1), min(end, split) + 1], np.float64) / self.share[queue]
            t, slack = self.earned(np.minimum(v, self.dry_at[-1])), 2 + len(self.n) // self.length
            first = max(0, int(t[0]) // self.length - slack)
            last = min(self.windows, int(t[1]) // self.length + 1 + slack)
            own, ahead = self._rows(queue, first, last + 1, cache)
            a = max(0, int(own.searchsorted(start, "right")) - 1)
            b = int(own.searchsorted(min(end, split), "left"))
            k = a + np.flatnonzero(own[a:b] < own[a + 1 : b + 1])
            begin = np.maximum(own[k], start)
            starts.append(begin), seqs.append(first + k), offs.append(ahead[k] + begin - own[k])
        if end > split:
            a, b = (int(self.rest_at[queue]) + x - split for x in (max(start, split), end))
            i = np.arange(int(np.searchsorted(self.rest_cuts, a, "right")) - 1, int(np.searchsorted(self.rest_cuts, b, "left")))
            begin = np.maximum(self.rest_cuts[i], a)
            starts.append(begin - int(self.rest_at[queue]) + split), seqs.append(self.windows + i), offs.append(begin - self.rest_cuts[i])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, seqs, offs))

    def _rows(self, queue: int, first: int, last: int, cache: dict, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows from first to before last: the queue's tokens before them, and the tokens of earlier queues in them.

        They are computed for blocks of windows, with all queues, and kept for a while.
        """
        own, ahead = [], []
        for b in range(first // block, (last - 1) // block + 1):
            if b not in cache:
                if len(cache) > 16:
                    cache.clear()
                cuts = self.served(np.arange(b * block, min((b + 1) * block, self.windows) + 1))
                width = np.diff(cuts, axis=0)
                cache[b] = np.ascontiguousarray(cuts.T), np.ascontiguousarray((np.cumsum(width, 1) - width).T)
            whole = b < (last - 1) // block  # the last row of a block is the first of the next
            own.append(cache[b][0][queue, :block] if whole else cache[b][0][queue])
            ahead.append(cache[b][1][queue])
        at = first % block
        if len(own) == 1:
            return own[0][at : at + last - first], ahead[0][at : at + last - first]
        return np.concatenate(own)[at : at + last - first], np.concatenate(ahead)[at : at + last - first]


def tokenised(docs: DataFrame, rank_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """doc_id, queue key, ids (little-endian, unsigned 16-bit), and each document's place in its task's part of the queue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), {}
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                some = pdf.iloc[lo : lo + 64]
                ids, n, place = [], [], []
                for text, queue in zip(some["text"], some["queue"]):
                    x = encode(text, rank_path, json_path)
                    x.append(END)
                    ids.append(np.array(x, "<u2").tobytes())
                    n.append(len(x))
                    place.append(at.get(queue, 0))
                    at[queue] = place[-1] + len(x)
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "queue": some["queue"], "part": part, "place": place, "n": n, "ids": ids})

    queue = F.coalesce("source", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), queue.alias("queue"))
    return rows.mapInPandas(run, "doc_id long, queue string, part int, place long, n long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, rank_path: str | None = None, json_path: str | None = None, with_ids: bool = True, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids of every piece of every row.

    A null text is empty: its document is the end token alone. A null source is a queue of its own, shared with the
    empty name. A null id is kept; repeated rows are packed each. All sequences but the last few hold exactly
    ``length`` tokens; what is left over is cut into sequences whose sizes are powers of two, so nothing is padded.

    targets: the parts of every window that sources are to have, in any unit; a source that is not named has its own
    part of all tokens, in the same unit as the named ones' parts would be. Up to MAX_QUEUES sources have queues of
    their own; beyond, a queue is shared by the sources of one hash, and can't have a target.
    """
    if targets and min(targets.values()) <= 0:
        raise ValueError("targets must be positive")
    spark = docs.sparkSession
    tokens = stored(tokenised(docs, rank_path, json_path), "packing-tokens")
    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    listed = totals.orderBy("queue").limit(MAX_QUEUES + 1).collect()
    if len(listed) > MAX_QUEUES:  # too many names to send: queues by hash, in the same way
        if targets:
            raise ValueError(f"targets need no more than {MAX_QUEUES} sources")
        hashed = docs.withColumn("source", F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(MAX_QUEUES)).cast("string"))
        return pack(hashed, length, rank_path, json_path, with_ids)
    number = {r.queue: i for i, r in enumerate(listed)}
    weights = None
    if targets:
        named, every = sum(r.n for r in listed if r.queue in targets), sum(targets.get(r.queue, 0.0) for r in listed)
        weights = np.array([targets.get(r.queue, r.n * every / max(1, named)) for r in listed], np.float64)
    sent = spark.sparkContext.broadcast((number, np.array([r.n for r in listed], np.int64), weights))
    base = sums.withColumn("base", F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).drop("n")
    if sum(r.parts for r in listed) <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = tokens.join(base, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("place")).alias("at"), "n", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, n, weights = sent.value
        mixture, cache = Mixture(n, length, weights), {}
        for pdf in batches:
            if not len(pdf):
                continue
            number = np.array([numbers[q] for q in pdf["queue"]])
            at, size = pdf["at"].to_numpy(), pdf["n"].to_numpy()
            order = np.lexsort((at, number))
            # documents that follow each other in a queue are cut together
            follows = (number[order][1:] == number[order][:-1]) & (at[order][1:] == (at + size)[order][:-1])
            found, crcs, raws = [], [], []
            for rows in np.split(order, np.flatnonzero(~follows) + 1):
                a, b = int(at[rows[0]]), int(at[rows[-1]] + size[rows[-1]])
                cuts, seqs, offs = mixture.pieces(int(number[rows[0]]), a, b, cache)
                starts = np.union1d(cuts, at[rows])
                piece, doc = np.searchsorted(cuts, starts, "right") - 1, np.searchsorted(at[rows], starts, "right") - 1
                count = np.diff(np.append(starts, b))
                found.append((rows[doc], starts - at[rows][doc], count, seqs[piece], offs[piece] + starts - cuts[piece]))
                wide = memoryview(np.concatenate([np.frombuffer(pdf["ids"].iat[i], "<u2") for i in rows]).astype("<u4").view(np.uint8))
                cut = [wide[x:y] for x, y in zip((4 * (starts - a)).tolist(), (4 * (starts - a + count)).tolist())]
                crcs += map(zlib.crc32, cut)
                if with_ids:
                    raws += map(bytes, cut)
            row, start, count, seq, off = (np.concatenate(x) for x in zip(*found))
            out = {"doc_id": pdf["doc_id"].astype("Int64").array[row], "start": start, "length": count, "ids_crc32": np.array(crcs, np.int64), "doc_tokens": size[row], "sequence_id": seq, "offset": off}
            yield pd.DataFrame(out | ({"ids": raws} if with_ids else {}))

    return placed.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
