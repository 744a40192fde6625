"""URL filter: sorted 64-bit digests, memory-mapped, probed by vectorised binary search.

A list entry is ``host/path-prefix`` with a verdict and a kind (an explicit rule, or an entry of a plain
blocklist). An entry fits its host and all sub-domains whose path starts with the entry's path. The probe
strings of a url are (host suffix) + (path prefix) for the path lengths that occur in the list. Their xxhash
digests are looked up in a sorted array, and the stored string is compared, so that a collision never decides.
"""

from __future__ import annotations

import mmap
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import stored

#: Rules of the contract: (host/path, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Hosts of the plain blocklist (fixed values).
BLOCKED_NAMES = ["adult-x", "casino-win", "cheap-pills", "spam-farm"]
BLOCKED_ZONES = ["com", "net", "org"]
BLOCKLIST = [f"{name}.example.{zone}/" for name in BLOCKED_NAMES for zone in BLOCKED_ZONES]
#: A packed list up to this size is broadcast; a larger one is cut into arrays of about the second size by ranges of its keys.
BROADCAST_BYTES, SHARD_BYTES = 64 << 20, 16 << 20
#: Batches of urls whose probes an array answers together.
BATCHES = 64

HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def entries(rules: Iterable[tuple[str, str]] = RULES, blocklist: Iterable[str] = BLOCKLIST) -> list[tuple[str, str, int]]:
    """(entry, verdict, is_rule); a rule replaces a blocklist entry of the same text."""
    out = {e: ("block", 0) for e in blocklist}
    out.update({e: (v, 1) for e, v in rules})
    return [(e, v, k) for e, (v, k) in sorted(out.items())]


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def pack(items: list[tuple[str, str, int]]) -> bytes:
    """The file: numbers of entries and of path lengths, then sorted keys, string offsets, path lengths, flags (1: block, 2: rule), and the strings."""
    keys = np.array([_digest(e) for e, _, _ in items], dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    flags = np.array([(v == "block") + 2 * k for _, v, k in items], dtype=np.uint8)[order]
    lengths = np.array(sorted({len(e) - e.index("/") for e, _, _ in items}), np.int64)
    raw = [items[i][0].encode("utf-8", "surrogatepass") for i in order]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return struct.pack("<qq", len(raw), len(lengths)) + keys[order].tobytes() + ends.tobytes() + lengths.tobytes() + flags.tobytes() + b"".join(raw)


class DigestArray:
    """A packed list, memory-mapped from a file that goes with the process."""

    def __init__(self, packed: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, m = struct.unpack_from("<qq", self.map, 0)
        self.keys = np.frombuffer(self.map, np.uint64, n, 16)
        self.ends = np.frombuffer(self.map, np.int64, n + 1, 16 + 8 * n)
        self.path_lengths = np.frombuffer(self.map, np.int64, m, 24 + 16 * n).tolist()
        self.flags = np.frombuffer(self.map, np.uint8, n, 24 + 16 * n + 8 * m)
        self.at = 24 + 17 * n + 8 * m

    def string(self, i: int) -> str:
        return self.map[self.at + self.ends[i] : self.at + self.ends[i + 1]].decode("utf-8", "surrogatepass")

    def find(self, probes: list[str]) -> np.ndarray:
        """The entry of each probe, or -1."""
        keys = np.fromiter(map(_digest, probes), np.uint64, len(probes))
        left = np.searchsorted(self.keys, keys, "left")
        found = np.full(len(probes), -1, np.int64)
        for p in np.flatnonzero((left < len(self.keys)) & (self.keys[np.minimum(left, max(0, len(self.keys) - 1))] == keys) if len(self.keys) else []):
            i = left[p]
            while i < len(self.keys) and self.keys[i] == keys[p]:
                if self.string(i) == probes[p]:
                    found[p] = i
                i += 1
        return found


def probes_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every entry text that could fit, without repeats."""
    if not host:
        return []
    at = [0] + [m.end() for m in re.finditer(r"\.", host)]
    heads = [path[:n] for n in lengths if n <= len(path)]
    return [host[a:] + h for a in at for h in heads if a < len(host)]


def _all_probes(pdf: pd.DataFrame, lengths: list[int]) -> tuple[list[str], list[int]]:
    """The probes of all urls of a batch, and the url of each."""
    probes, owner = [], []
    for i, (host, path) in enumerate(zip(pdf["host"], pdf["path"])):
        own = probes_of(host, path, lengths)
        probes += own
        owner += [i] * len(own)
    return probes, owner


def _judged(pdf: pd.DataFrame, hits: Iterable[tuple[int, str, int]]) -> pd.DataFrame:
    """The urls of a batch with their rule and verdict, from (url, entry, flags) of all entries that fit."""
    rule: list[str | None] = [None] * len(pdf)
    best: list[tuple] = [()] * len(pdf)
    blocked = [False] * len(pdf)
    for i, text, flag in hits:
        if flag & 2:
            mark = (len(text), text.index("/"))
            if not best[i] or mark > best[i][:2]:
                best[i], rule[i] = (*mark, "block" if flag & 1 else "allow"), text
        else:
            blocked[i] = True
    verdict = [b[2] if b else "block" if x else "allow" for b, x in zip(best, blocked)]
    return pdf.assign(rule=pd.Series(rule, index=pdf.index, dtype=object), verdict=verdict)


def listed_entries(table: DataFrame) -> DataFrame:
    """entry, verdict, is_rule, each entry once, from a table with these columns.

    Null entries go, and an entry without a path gets the path ``/``. Of rows with one entry a rule goes before a plain
    one, and block before allow.
    """
    entry = F.when(F.instr("entry", "/") > 0, F.col("entry")).otherwise(F.concat("entry", F.lit("/")))
    rows = table.where("entry is not null").select(entry.alias("entry"), F.struct(F.coalesce(F.col("is_rule").cast("int"), F.lit(0)).alias("k"), F.coalesce("verdict", F.lit("block")).alias("v")).alias("what"))
    return rows.groupBy("entry").agg(F.max("what").alias("what")).select("entry", F.col("what.v").alias("verdict"), F.col("what.k").alias("is_rule"))


def judge_urls(pages: DataFrame, items: list[tuple[str, str, int]] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    The longest rule that fits decides; without one, a page on the blocklist is blocked, else allowed. Of two
    fitting rules of equal length the one with the longer host wins. A null url, or one without ``://``, has an
    empty host and path and is allowed. Repeated rows are judged each; a null id is kept; other columns are ignored.

    items: a list of (entry, verdict, is_rule), or a table of them (see listed_entries), which never passes through the
    driver beyond ``broadcast_bytes``. A larger list is held as digest arrays of ranges of the keys, of about
    ``shard_bytes`` each.
    """
    spark = pages.sparkSession
    parts = pages.select(
        F.col(id_col).cast("string").alias("page_id"),  # as text, since pandas makes floats of whole numbers beside nulls
        F.translate(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "(?s)" + HOST, 1), _UPPER, _UPPER.lower()).alias("host"),
        F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "(?s)" + PATH, 1).alias("path"),
    )
    own, out = pages.schema[id_col].dataType, "page_id string, host string, path string, rule string, verdict string"

    def finished(df: DataFrame) -> DataFrame:
        return df.withColumn("page_id", F.col("page_id").cast(own))

    if isinstance(items, DataFrame):
        listed = stored(listed_entries(items), "url-list")
        size = listed.agg(F.sum(F.octet_length("entry") + F.lit(33))).first()[0] or 0
        if size > broadcast_bytes:
            return finished(_judge_by_shards(parts, listed, -(-size // shard_bytes), out))
        items = [tuple(r) for r in listed.collect()]
    packed = pack(entries() if items is None else items)
    if len(packed) > broadcast_bytes:
        listed = spark.createDataFrame(entries() if items is None else items, "entry string, verdict string, is_rule int")
        return finished(_judge_by_shards(parts, listed, -(-len(packed) // shard_bytes), out))
    sent = spark.sparkContext.broadcast(packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests = DigestArray(sent.value)
        for pdf in batches:
            probes, owner = _all_probes(pdf, digests.path_lengths)
            found = digests.find(probes)
            yield _judged(pdf, ((owner[p], probes[p], int(digests.flags[found[p]])) for p in np.flatnonzero(found >= 0)))

    return finished(parts.mapInPandas(run, out))


def _judge_by_shards(parts: DataFrame, listed: DataFrame, shards: int, out: str) -> DataFrame:
    """The same with a list that is too large to send: each range of the keys is a digest array of its own.

    Urls are read in batches. A batch sends its distinct probes, once each, to the arrays whose range they fall in, and
    gets back those that are listed; so a probe that most urls share is one row a batch, and no key is hot.
    """
    lengths = sorted(r[0] for r in listed.select((F.length("entry") - F.instr("entry", "/") + 1).alias("n")).distinct().collect())  # at most as many as the longest entry has characters

    def shard_of(text: str) -> int:
        return _digest(text) * shards >> 64

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(shard=[shard_of(e) for e in pdf["entry"]])

    def array_of(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "packed": [pack(list(zip(pdf["entry"], pdf["verdict"], pdf["is_rule"])))]})

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 32
        for i, pdf in enumerate(batches):
            yield pdf.assign(batch=at + i)

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        by_shard: dict[int, list[str]] = {}
        for p in dict.fromkeys(_all_probes(pdf, lengths)[0]):
            by_shard.setdefault(shard_of(p), []).append(p)
        rows = [(s, pdf["batch"].iloc[0], p) for s, p in by_shard.items()]
        return pd.DataFrame(rows, columns=["shard", "batch", "probes"], dtype=object)

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        digests = DigestArray(left["packed"].iloc[0]) if len(left) else None
        for batch, probes in zip(right["batch"], right["probes"]) if digests else ():
            found = digests.find(list(probes))
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                rows.append((batch, [probes[i] for i in hit], digests.flags[found[hit]].astype(np.int32).tolist()))
        return pd.DataFrame(rows, columns=["batch", "entries", "flags"], dtype=object)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        flags = {e: f for es, fs in zip(right["entries"], right["flags"]) for e, f in zip(es, fs)}
        left = left.drop(columns="batch")
        probes, owner = _all_probes(left, lengths)
        return _judged(left, ((i, p, flags[p]) for i, p in zip(owner, probes) if p in flags))

    arrays = listed.mapInPandas(deal, "entry string, verdict string, is_rule int, shard long").groupBy("shard").applyInPandas(array_of, "shard long, packed binary")
    urls = stored(parts.mapInPandas(number, ", ".join(f"{n} {t}" for n, t in parts.dtypes) + ", batch long"), "url-batches")
    asked = stored(urls.groupBy("batch").applyInPandas(ask, "shard long, batch long, probes array<string>"), "url-probes")
    # an array meets the batches in groups of bounded size
    blocks = max(1, -(-urls.select("batch").distinct().count() // BATCHES))
    arrays = arrays.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.hash("batch"), F.lit(blocks)))
    hits = arrays.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(answer, "batch long, entries array<string>, flags array<int>")
    return urls.groupBy("batch").cogroup(hits.groupBy("batch")).applyInPandas(finish, out)
