"""Token counts by a separator scan.

A flat token file is a run of fixed-width ids without an index; documents end with an end-of-document id. Blocks of
the file are searched on their own with vector operations. A block tells how many ids it has before its first
separator, the lengths of the documents that lie whole in it, and how many ids follow its last one. A prefix scan
over the blocks' summaries joins what crosses their boundaries and numbers the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlake.llm.common import stored
from speechlake.llm.tokens import EOD, encode_plain

BLOCK_BYTES = 1 << 18


def read_flat(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, data of flat binary files below a path, by Spark's own reader of binary files.

    The reader takes a file as one value, so files over 2 GB have to be split by whoever writes them.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                for i in range(0, len(data), block_bytes):
                    yield pd.DataFrame({"file": [name], "block": [i // block_bytes], "data": [data[i : i + block_bytes]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "file string, block long, data binary")


def write_blocks(docs: DataFrame, eod: int = EOD, block_bytes: int = BLOCK_BYTES, rank_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokenise documents into one flat file a task, held as blocks, and the order of documents in each file.

    Returns (file, block, data) and (file, ordinal, doc_id). Blocks are cut at fixed sizes, wherever documents end. An
    end-of-text string in a text is encoded as ordinary text: all of its ids count, and none of them is a separator.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, rest, block, ordinal = str(TaskContext.get().partitionId()), b"", 0, 0
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                some = pdf.iloc[lo : lo + 64]
                raw = [rest]
                for text in some["text"]:
                    ids = encode_plain(text, rank_path)
                    ids.append(eod)
                    raw.append(np.array(ids, "<u2").tobytes())
                data, rest = b"".join(raw), b""
                full = len(data) // block_bytes * block_bytes
                rest = data[full:]
                rows = [(name, block + i // block_bytes, data[i : i + block_bytes], None, None) for i in range(0, full, block_bytes)]
                block += full // block_bytes
                rows += [(name, None, None, ordinal + i, d) for i, d in enumerate(some["doc_id"].astype(object))]
                ordinal += len(some)
                yield frame(rows)
        if rest:
            yield frame([(name, block, rest, None, None)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["file", "block", "data", "ordinal", "doc_id"])
        return out.astype({"block": "Int64", "ordinal": "Int64", "doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = stored(rows.mapInPandas(run, "file string, block long, data binary, ordinal long, doc_id long"), "flat-tokens")
    return both.where("block is not null").select("file", "block", "data"), both.where("ordinal is not null").select("file", "ordinal", "doc_id")


def count_tokens(blocks: DataFrame, eod: int = EOD, width: str = "<u2") -> DataFrame:
    """file, ordinal, n_tokens, closed: ids before each separator, for every document of every file, empty ones too.

    Ids after the last separator of a file make a last document with closed = false. A file without ids has none. A
    null block of data counts as empty. A block's size must be a multiple of the id's.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, block, data in zip(pdf["file"], pdf["block"], pdf["data"]):
                ids = np.frombuffer(data or b"", width)
                ends = np.flatnonzero(ids == eod)
                if len(ends):
                    rows.append((name, block, len(ends), int(ends[0]), int(len(ids) - 1 - ends[-1]), (np.diff(ends) - 1).tolist()))
                else:
                    rows.append((name, block, 0, len(ids), len(ids), []))
            yield pd.DataFrame(rows, columns=["file", "block", "n_ends", "head", "tail", "inner"])

    found = stored(blocks.mapInPandas(scan, "file string, block long, n_ends long, head long, tail long, inner array<long>"), "token-blocks")
    inner, found = found.where("n_ends > 0").select("file", "block", "inner"), found.drop("inner")  # the scan is over summaries alone
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # ids since the last separator: a running sum that starts anew after every block that has one
    run = found.withColumn("group", F.coalesce(F.sum((F.col("n_ends") > 0).cast("long")).over(before), F.lit(0)))
    tail = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.lag("tail").over(order)
    starts = F.col("group") != F.coalesce(F.lag("group").over(order), F.lit(0))
    run = run.withColumn("carry", F.when(starts, last)).withColumn("lone", F.when(F.col("n_ends") == 0, F.col("tail")).otherwise(0))
    run = run.withColumn("open", F.coalesce(F.sum("lone").over(tail), F.lit(0)) + F.coalesce(F.first("carry", True).over(tail.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    run = run.withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn("final", F.lead("block").over(order).isNull())
    closed = run.where("n_ends > 0").join(inner, ["file", "block"]).select("file", "first", F.posexplode(F.concat(F.array(F.col("head") + F.col("open")), "inner")).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    rest = F.when(F.col("n_ends") == 0, F.col("open") + F.col("tail")).otherwise(F.col("tail"))
    left = run.where("final").select("file", (F.col("first") + F.col("n_ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.unionByName(left)


def document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, file, ordinal, n_tokens of every row, read back from flat files. Null texts are empty; repeated rows count each. An end-of-text string in a text counts as the ordinary tokens of its characters."""
    blocks, order = write_blocks(docs)
    return order.join(count_tokens(blocks), ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", "n_tokens")
