"""Ranked lexical search by NRA over impact-sorted lists.

A document's score for an item is a sum over the item's terms of weight times impact, all in whole numbers. Documents
are indexed in shards, each a run of rows of the table: a shard has for every term its documents by falling impact, and
is searched for every item on its own, so lists are never shuffled and no term is a hot key; only the best of each
shard go on. In a shard the lists of an item's terms are read in sequence, a block of each at a time. A document's
lower bound is the sum of what was read of it; its upper bound adds, for each list in which it was not yet met, the
last impact read there. Documents whose upper bound is below the k-th highest lower bound go for good; reading ends
when the bounds of all that are left meet, so membership, ties and scores are final. Documents are never looked up.

The terms of the items are broadcast, in blocks of items whose terms have a fixed bound; more items are more passes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlake.llm.common import discard, stored

#: Documents and postings of a shard, entries that the first reads of a list take, and how much longer each next read is.
SHARD_DOCS, SHARD_POSTINGS, FIRST_READ, LONGER = 16_384, 2_000_000, 256, 4
#: Distinct terms, and bytes of them, in a block of items.
BLOCK_TERMS, BLOCK_BYTES = 200_000, 16_000_000
#: Bytes of a text that are cut into terms at once.
PART = 4_000_000
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
#: A-Z to a-z, every ASCII character that is no letter or digit to a blank.
_FOLD = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, a part of the text at a time."""
    raw, lo = text.encode("utf-8", "surrogatepass").translate(_FOLD), 0
    while lo < len(raw):
        hi = raw.find(b" ", lo + PART) if lo + PART < len(raw) else -1
        hi = len(raw) if hi < 0 else hi
        yield raw[lo:hi].split()
        lo = hi


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


class Shard:
    """Impact-sorted lists of some documents. ``docs`` and ``impacts`` are lists in a row; term t's is from starts[t] to starts[t + 1]."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.docs, self.impacts, self.n_docs = doc[order], impact[order].astype(np.float64), n_docs
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])

    def search(self, terms: np.ndarray, factors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, entries read): the k best, ties to the smaller id, of those that score above 0. Sums stay below 2^53, so doubles hold them exactly."""
        used = (self.starts[terms + 1] > self.starts[terms]) & (factors > 0)
        lists, factors = terms[used], factors[used].astype(np.float64)
        at, ends = self.starts[lists].copy(), self.starts[lists + 1]
        place = np.arange(self.n_docs)  # of a document among those that are left, or -1
        left = place
        lower, met = np.zeros(self.n_docs), np.zeros((self.n_docs, len(lists)), bool)
        last = factors * self.impacts[at] if len(lists) else factors
        step, n_read = FIRST_READ, 0
        while True:
            for j in np.flatnonzero(at < ends):
                to = min(at[j] + step, ends[j])
                own = place[self.docs[at[j] : to]]
                hit = own >= 0
                lower[own[hit]] += factors[j] * self.impacts[at[j] : to][hit]  # a document is in a list once
                met[own[hit], j] = True
                n_read += to - at[j]
                at[j], last[j] = to, factors[j] * self.impacts[to - 1] if to < ends[j] else 0.0
            open_lists = np.flatnonzero(last > 0)
            upper = lower + last.sum() - met[:, open_lists] @ last[open_lists] if len(open_lists) else lower
            least = max(np.partition(lower, len(lower) - k)[len(lower) - k], 1.0) if len(lower) > k else 1.0
            stay = upper >= least
            left, lower, met, upper = left[stay], lower[stay], met[stay], upper[stay]
            if np.array_equal(lower, upper):
                break
            place = np.full(self.n_docs, -1)
            place[left] = np.arange(len(left))
            step *= LONGER
        best = np.lexsort((ids[left], -lower))[:k]
        return left[best], lower[best].astype(np.int64), n_read


def _items(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple[int, int | None, Counter]], list[bytes]]]:
    """Blocks of items with their terms, and the distinct terms of each block. Equal rows are one item; items come one by one to the driver."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    block, names, size = [], {}, 0
    for number, row in enumerate(rows.orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator()):
        own = Counter(t for some in terms_of(row.text) for t in some)
        if not own:
            continue
        new = [t for t in own if t not in names]
        if block and (len(names) + len(new) > BLOCK_TERMS or size + sum(map(len, new)) > BLOCK_BYTES):
            yield block, list(names)
            block, names, size, new = [], {}, 0, list(own)
        names.update((t, len(names) + i) for i, t in enumerate(new))
        size += sum(map(len, new))
        block.append((number, row.item_id, own))
    if block:
        yield block, list(names)


def _counted(spark: SparkSession, docs: DataFrame, names: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all its terms), terms and tfs (of those asked for), of every row that has a term; stored."""
    at = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = at.value.get
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, found = 0, []
                for some in terms_of(text):
                    n += len(some)
                    hits = [i for i in map(number, some) if i is not None]
                    found.append(np.unique(np.array(hits, np.int32), return_counts=True))
                if n:
                    terms = np.concatenate([t for t, _ in found])
                    tfs = np.concatenate([c for _, c in found])
                    if len(found) > 1:
                        terms, back = np.unique(terms, return_inverse=True)
                        tfs = np.bincount(back, tfs, len(terms)).astype(np.int64)
                    out.append((doc_id, n, terms, tfs))
            yield _batch(out, doc_id=pa.int64(), n=pa.int64(), terms=pa.list_(pa.int32()), tfs=pa.list_(pa.int64()))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"), "search-counted")


def _searched(spark: SparkSession, counted: DataFrame, block: list, names: list[bytes], k: int) -> DataFrame:
    """item, doc_id, score: the best k of every shard."""
    n_docs, all_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)  # a number for each term of the block
    for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[row.t] = row["count"]
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    at = {t: i for i, t in enumerate(names)}
    asked = []
    for number, _, own in block:
        terms = np.array([at[t] for t in own], np.int64)
        asked.append((number, terms, weights[terms] * np.array(list(own.values()), np.int64)))
    shared, n_names = spark.sparkContext.broadcast(asked), len(names)

    def search(rows: list[tuple]) -> pa.RecordBatch:
        ids = np.array([np.iinfo(np.int64).max if x is None else x for x, *_ in rows], np.int64)
        lengths = np.array([len(t) for _, _, t, _ in rows])
        spread = np.array([25 + 75 * int(n) * n_docs // all_terms for _, n, _, _ in rows], np.int64)
        tf = np.concatenate([c for *_, c in rows])
        shard = Shard(np.concatenate([t for _, _, t, _ in rows]), np.repeat(np.arange(len(rows)), lengths), 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(spread, lengths)), len(rows), n_names)
        out = []
        for number, terms, factors in shared.value:
            found, scores, _ = shard.search(terms, factors, ids, k)
            out += [(number, rows[d][0], int(s)) for d, s in zip(found, scores)]
        return _batch(out, item=pa.int64(), doc_id=pa.int64(), score=pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            lists = [[x.values.to_numpy() for x in batch.column(c)] for c in ("terms", "tfs")]
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), *lists):
                rows.append(row)
                size += len(row[2])
                if len(rows) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    yield search(rows)
                    rows, size = [], 0
        if rows:
            yield search(rows)

    return counted.mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; null and empty
    texts have none. Every row of ``docs`` with a term is a document, repeated rows and rows without an id too; equal
    scores go by rising id, null last. Equal rows of ``items`` are one item; rows that share an id but not the text are
    items of their own, ranked each from 1, and items without a term have no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts, ids = [], []
    for block, names in _items(items, item_id, text_col):
        counted = _counted(spark, docs, names, doc_id, text_col)
        parts.append(stored(_searched(spark, counted, block, names, k), "search-found"))
        discard(counted)
        ids += [(number, own) for number, own, _ in block]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(spark.createDataFrame(ids, "item long, item_id long"), "item").select("item_id", "rank", "doc_id", "score")
