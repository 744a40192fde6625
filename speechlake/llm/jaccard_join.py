"""Exact Jaccard self-join of word n-gram sets, by partitions of the universe and the pigeonhole principle.

Sizes fall into bands; a pair belongs to the band of its smaller set. Two sets above the threshold whose smaller size
is at most u differ in at most H = (1 - t) / t * u members, so of H + 1 segments of the hashed universe one has equal
subsets. A set signs the segments of its own band, and of the band below if a partner can lie there. Costs allot the
signatures: an empty subset, which most sets share, signs nothing; what is lost by that is made up in a few segments
that also sign their one-deletion neighbourhoods, which prove a segment equal up to one member and so count twice.
Only a set for which that does not suffice signs its empty subsets too. Sets that share a signature are compared in
full, exactly.

Sets with equal members are one class from the start. Signatures that several sets share are met at their smallest id
first; then only sets that are still in different components are compared with each other, so that no link between
components is lost. Groups are compared in blocks inside tasks, by bitmaps that bound the intersection from above; a
pair becomes a row only if its bound reaches the threshold, and is then verified. So no group is written out as pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import discard, mark_of, places, release, shuffle_partitions, stored, text_of, trimmed
from speechlake.llm.components import components
from speechlake.llm.lm import pack_ints, unpack_ints

WORDS, PERCENT = 4, 85
#: Bytes of text whose signatures are gathered before they are sent.
BATCH_BYTES = 4 << 20
#: Sets of a group that are compared in one block.
BLOCK = 1_024
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _A
        x = (x ^ (x >> np.uint64(29))) * _B
        return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """The set of 64-bit hashes of a text's n-word runs, in rising order; of its whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * _C + h[i : len(h) - k + 1 + i])
    return np.unique(out)


class Bands:
    """Size bands and their numbers of segments for a threshold in hundredths."""

    def __init__(self, percent: int = PERCENT, growth: float = 1.6, largest: int = 1 << 40):
        self.percent, self.tops = percent, [self._same(1, percent)]
        while self.tops[-1] < largest:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * growth)))

    @staticmethod
    def _same(u: int, percent: int) -> int:
        """The largest size at which two sets above the threshold must be equal."""
        while (100 - percent) * (u + 1) < percent:
            u += 1
        return u

    def of(self, size: int) -> list[int]:
        """Bands that a set signs; none where it can only equal others."""
        own = bisect_left(self.tops, size)
        below = own > 0 and 100 * self.tops[own - 1] >= self.percent * size
        return [b for b in ([own - 1] if below else []) + [own] if b > 0]

    def segments(self, band: int) -> int:
        return (100 - self.percent) * self.tops[band] // self.percent + 1

    def doubled(self, band: int) -> int:
        """Segments that sign their neighbourhoods: about twice the empty ones that a small set of the band expects."""
        m = self.segments(band)
        return min(m, 1 + int(2 * m * np.exp(-max(1, self.tops[band - 1]) / m)))


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set's index) of all sets, distinct."""
    sigs, owners = [], []
    jobs: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for b in bands.of(len(s)):
            jobs.setdefault(b, []).append(i)
    for band, own in jobs.items():
        m, d = bands.segments(band), bands.doubled(band)
        size = np.array([len(sets[i]) for i in own])
        members = np.concatenate([sets[i] for i in own])
        owner = np.repeat(np.arange(len(own)), size)
        segment = (mix(members ^ _C) % np.uint64(m)).astype(np.int64)
        value = mix(members ^ mix(np.array([band + 1], np.uint64)))
        cell = owner * m + segment
        order = np.argsort(cell, kind="stable")
        cell, value, members = cell[order], value[order], members[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        count = np.diff(np.append(first, len(cell)))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(value, first)
            label = mix((cell[first] % m).astype(np.uint64) * _B + np.uint64(band))
            sign = mix(total ^ label)
            sigs.append(sign)
            owners.append(cell[first] // m)
            # neighbourhoods of the first d segments, where at least two members stand
            wide = (cell[first] % m < d) & (count >= 2)
            at = np.repeat(wide, count)
            sigs.append(mix((np.repeat(total, count)[at] - value[at]) ^ np.repeat(label, count)[at]))
            owners.append(cell[at] // m)
            filled = np.bincount(cell[first] // m, minlength=len(own))
            twice = np.bincount((cell[first] // m)[wide], minlength=len(own))
            for i in np.flatnonzero(filled + twice < m):  # not enough: sign the empty ones as well
                empty = np.setdiff1d(np.arange(m), segment[owner == i]).astype(np.uint64)
                sigs.append(mix(mix(empty * _B + np.uint64(band))))
                owners.append(np.full(len(empty), i))
        for k in range(len(owners) - 1, -1, -1):  # from places in this band to the sets' own
            if owners[k].dtype != np.int32:
                owners[k] = np.array(own, np.int32)[owners[k]]
            else:
                break
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    sig, own = np.concatenate(sigs), np.concatenate(owners)
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])])
    return sig[new], own[new]


SIGNED = "kind int, batch long, place int, mark binary, n long, d1 long, d2 long, bucket int, sigs binary, places binary"


def signed(rows: DataFrame, buckets: int, words: int, percent: int) -> DataFrame:
    """kind 0: a document's place, set size and set digest. kind 1: a batch's signatures of one bucket, and their places.

    Of equal sets in a batch only the first has signatures.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, hashes = Bands(percent), WordHashes()
        batch, size = TaskContext.get().partitionId() << 32, 0
        docs: list[tuple] = []
        sets: list[np.ndarray] = []
        known: dict[tuple, int] = {}

        def flush() -> pd.DataFrame:
            meta = pd.DataFrame(docs, columns=["mark", "n", "d1", "d2", "place"]).assign(kind=0, batch=batch, bucket=-1, sigs=None, places=None)
            sig, own = signatures(sets, bands)
            # buckets are equal ranges of the signatures' values, so a bucket's part is one slice
            edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
            cut = np.concatenate([[0], np.searchsorted(sig, edges, "left"), [len(sig)]])
            parts = [(b, pack_sorted(sig[a:z]), pack_ints(own[a:z])) for b, (a, z) in enumerate(zip(cut, cut[1:])) if a < z]
            out = pd.DataFrame(parts, columns=["bucket", "sigs", "places"]).assign(kind=1, batch=batch, place=-1, mark=b"", n=0, d1=0, d2=0)
            return pd.concat([meta, out])[[c.split()[0] for c in SIGNED.split(", ")]]

        for pdf in batches:
            for mark, text in zip(pdf["mark"], pdf["text"]):
                s = shingles(bytes(text), hashes, words)
                d = divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64)
                place = known.setdefault(d, len(sets))
                if place == len(sets):
                    sets.append(s)
                docs.append((mark, len(s), *np.array(d, np.uint64).view(np.int64), place))
                size += len(text)
                if size >= BATCH_BYTES:
                    yield flush()
                    batch, size, docs, sets, known = batch + 1, 0, [], [], {}
        if docs:
            yield flush()

    return rows.mapInPandas(trimmed(run), SIGNED)


def pack_sorted(sig: np.ndarray) -> bytes:
    return int(sig[0]).to_bytes(8, "little") + pack_ints(np.diff(sig).astype(np.int64)) if len(sig) else b""


def unpack_sorted(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = unpack_ints(b[8:]).astype(np.uint64)
        return np.cumsum(np.concatenate([[np.uint64(int.from_bytes(b[:8], "little"))], steps]), dtype=np.uint64)


def shared_signatures(parts: DataFrame) -> DataFrame:
    """sig, batch, place of the signatures that several sets have, from all batches' parts of each bucket."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sigs = [unpack_sorted(x) for x in pdf["sigs"]]
        batch = np.repeat(pdf["batch"].to_numpy(), [len(x) for x in sigs])
        place = np.concatenate([unpack_ints(x) for x in pdf["places"]]).astype(np.int32)
        sig = np.concatenate(sigs)
        order = np.argsort(sig, kind="stable")
        same = sig[order][1:] == sig[order][:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        return pd.DataFrame({"sig": sig[order].view(np.int64), "batch": batch[order], "place": place[order]})

    return parts.groupBy("bucket").applyInPandas(meet, "sig long, batch long, place int")


def bitmap(members: np.ndarray) -> np.ndarray:
    """Bits of the members' hashes, at least four for each member; longer maps fold onto shorter ones."""
    bits = max(64, 1 << int(4 * len(members) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mix(members ^ _B) % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out)


def sets_of(rows: DataFrame, words: int) -> DataFrame:
    """key, n, members (8 bytes each), bits of a table (key, text as bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                some = pdf.iloc[lo : lo + 256]
                sets = [shingles(bytes(t), hashes, words) for t in some["text"]]
                yield pd.DataFrame({"key": some["key"].array, "n": [len(x) for x in sets], "members": [x.tobytes() for x in sets], "bits": [bitmap(x).tobytes() for x in sets]})

    return rows.mapInPandas(trimmed(run), "key long, n long, members binary, bits binary")


def near_pairs(ids: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, maps: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in different components whose bound reaches the threshold; places of the sides 1 and 2 meet only across."""
    width = min(len(m) for m in maps)
    table = np.zeros((len(maps), width), np.uint8)
    for i, m in enumerate(maps):
        np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0, out=table[i])
    table = table.view(np.uint64) if width % 8 == 0 else table
    spare = n - np.bitwise_count(table).sum(1, dtype=np.int64)  # members that share their bit with another
    left, right = [], []
    for i in range(len(ids) - 1):
        ok = (label[i + 1 :] != label[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 0)) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            most = np.bitwise_count(table[j] & table[i]).sum(1, dtype=np.int64) + np.minimum(spare[j], spare[i])
            j = j[(100 + percent) * most >= percent * (n[j] + n[i])]
            left.append(np.full(len(j), i))
            right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def most_shared(n: np.ndarray, m: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Upper bounds of the intersections of pairs of sets, from their sizes and bitmaps."""
    out = np.zeros(len(n), np.int64)
    wide = np.array([(len(x), len(y)) for x, y in zip(left, right)]).reshape(-1, 2)
    for x, y in np.unique(wide, axis=0).tolist():
        at = np.flatnonzero((wide == (x, y)).all(1))
        width = min(x, y)
        maps = [np.bitwise_or.reduce(np.frombuffer(b"".join(bytes(side[i]) for i in at), np.uint8).reshape(len(at), -1, width), axis=1) for side in (left, right)]
        spare = [size[at] - np.bitwise_count(bits).sum(1, dtype=np.int64) for size, bits in zip((n, m), maps)]
        out[at] = np.bitwise_count(maps[0] & maps[1]).sum(1, dtype=np.int64) + np.minimum(*spare)
    return out


def bounded(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps' bound on the intersection reaches the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, m = pdf["n"].to_numpy(), pdf["m"].to_numpy()
            most = most_shared(n, m, pdf["bits"].tolist(), pdf["others"].tolist())
            yield pdf.loc[(100 + percent) * most >= percent * (n + m), ["a", "b"]]

    left, right = maps.withColumnRenamed("key", "a"), maps.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("bits").alias("others"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "bits", "others").mapInPandas(trimmed(run), "a long, b long")


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of a table (sig, p, q, side, key, n, label, bits) whose rows of one (sig, p, q) are compared in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["sig", "p", "q"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if not len(cut):
                rest = pdf
                continue
            yield pairs_of(pdf.iloc[: cut[-1]], cut[:-1])
            rest = pdf.iloc[cut[-1] :]
        if rest is not None and len(rest):
            key = rest[["sig", "p", "q"]].to_numpy()
            yield pairs_of(rest, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)

    def pairs_of(pdf: pd.DataFrame, cut: np.ndarray) -> pd.DataFrame:
        ids, n, label, side = (pdf[c].to_numpy() for c in ("key", "n", "label", "side"))
        maps, found = pdf["bits"].tolist(), []
        for a, z in zip([0, *cut], [*cut, len(pdf)]):
            if z - a > 1:
                x, y = near_pairs(ids[a:z], n[a:z], label[a:z], side[a:z], maps[a:z], percent)
                found.append(np.stack([ids[a:z][x], ids[a:z][y]]))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        both = np.unique(np.sort(both, axis=0), axis=1)
        return pd.DataFrame({"a": both[0], "b": both[1]})

    dealt = rows.select("sig", "p", "q", "side", "key", "n", "label", "bits").repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q")
    return dealt.mapInPandas(trimmed(run), "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, last, x = [], None, None
            for a, m, o in zip(pdf["a"], pdf["members"], pdf["others"]):
                if a != last:
                    last, x = a, np.frombuffer(m, np.uint64)
                y = np.frombuffer(o, np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    left, right = sets.select(F.col("key").alias("a"), "members"), sets.select(F.col("key").alias("b"), F.col("members").alias("others"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "members", "others").mapInPandas(trimmed(run), "a long, b long")


def open_blocks(labelled: DataFrame) -> DataFrame:
    """sig, p, q, side, key, label: who is to be compared with whom, of a table (sig, key, label) of groups.

    In a group the members that have its most frequent label are met only by the others, not by each other. Both kinds
    fall into blocks; block p of the others meets itself, those after it, and every block of the most frequent label. So
    rows grow with the others times the group, not with its square. Groups of the same labelled members go once.
    """
    counts = labelled.groupBy("sig", "label").agg(F.count("*").alias("c"), F.sum(F.xxhash64("key", "label").cast("decimal(38,0)")).alias("d"))
    groups = counts.groupBy("sig").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("c"), F.sum("d").alias("d"), F.count("*").alias("labels")).where("labels > 1")
    once = groups.groupBy("c", "d", "top", "labels").agg(F.min("sig").alias("sig"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    once = stored(once.select("sig", F.col("top.label").alias("most"), blocks(F.col("c") - F.col("top.c")).alias("others"), blocks(F.col("top.c")).alias("mosts")), "jaccard-open")
    rows = labelled.join(once, "sig").withColumn("is_most", F.col("label") == F.col("most"))
    own = F.when(F.col("is_most"), F.col("others") + F.pmod(F.hash("key"), F.col("mosts"))).otherwise(F.pmod(F.hash("key"), F.col("others")))
    last = F.when(F.col("is_most"), F.col("others")).otherwise(F.col("others") + F.col("mosts")) - 1
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select("sig", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), side.alias("side"), "key", "label")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every document.

    component_id is the smallest id among all that links reach, class_id the smallest id with the same set. A text
    without words has an empty set and is linked with nothing. A null text is empty. Rows equal in id and text are one
    document; rows that share an id but not the text are documents of their own, and so are rows without an id, whose
    component_id is null where they are linked with no document that has one. Other columns are ignored. Members are
    told apart by 64-bit hashes, sets by 128-bit ones.
    """
    return marked_components(docs, words, percent).drop("mark", "is_first")


def marked_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """As jaccard_components, with the document's mark (see common.mark_of) and whether it is the first of its component."""
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    rows = text_of(docs).select("doc_id", F.col("text").cast("binary").alias("text"), mark_of().alias("mark"))
    out = stored(signed(rows.drop("doc_id"), buckets, words, percent), "jaccard-signed")
    at = places(rows.select("mark", "doc_id"))
    meta = stored(out.where("kind = 0").select("mark", "n", "d1", "d2", "batch", "place").join(at, "mark"), "jaccard-meta")
    classes = stored(meta.where("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("class")), "jaccard-equal")
    of_class = meta.join(classes, ["d1", "d2"], "left").select("mark", "doc_id", "key", "n", "batch", "place", F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("key")).alias("class"))
    of_class = stored(of_class, "jaccard-classes")
    release(spark)
    firsts = of_class.where("n > 0").groupBy("batch", "place").agg(F.min("class").alias("key"), F.min("n").alias("n"))
    shared = shared_signatures(out.where("kind = 1").select("bucket", "batch", "sigs", "places"))
    shared = stored(shared.join(firsts, ["batch", "place"]).select("sig", "key", "n").distinct(), "jaccard-shared")
    discard(out, at, meta, classes)
    release(spark)
    heads = shared.groupBy("sig").agg(F.min(F.struct("key", "n")).alias("h"), F.count("*").alias("c")).where("c > 1")
    heads = stored(heads.select("sig", F.col("h.key").alias("a"), F.col("h.n").alias("m")), "jaccard-heads")
    release(spark)
    met = shared.join(heads.select("sig"), "sig", "left_semi").select("key").distinct()
    wanted = of_class.where("key = class").join(met, "key", "left_semi").select("mark", "key").distinct()
    sets = stored(sets_of(rows.select("mark", "text").join(wanted, "mark").select("key", "text"), words).dropDuplicates(["key"]), "jaccard-sets")
    release(spark)
    maps = sets.select("key", "n", "bits")
    # first every set with the head of its groups, each pair once
    tried = shared.select("sig", F.col("key").alias("b"), "n").join(heads, "sig").where((F.col("a") != F.col("b")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))).select("a", "b").distinct()
    close = stored(bounded(tried, maps, percent), "jaccard-close")
    release(spark)
    links = stored(verified(close, sets, percent), "jaccard-links")
    release(spark)
    labels = components(links)
    # then what shares a signature and is not yet connected
    of = shared.join(heads.select("sig"), "sig", "left_semi").join(labels, shared["key"] == labels["node"], "left").select("sig", "key", F.coalesce("component", "key").alias("label"))
    of = stored(of, "jaccard-labelled")
    discard(shared, heads)
    release(spark)
    more = stored(compared(open_blocks(of).join(maps, "key"), percent), "jaccard-more")
    discard(of)
    release(spark)
    every = stored(links.union(verified(more, sets, percent)), "jaccard-links")
    discard(links, more, close, sets)
    release(spark)
    labels = components(every)
    one = of_class.select("mark", "doc_id", "key", "n", "class").distinct()
    found = stored(one.join(labels, one["class"] == labels["node"], "left").select("mark", "doc_id", "key", "n", "class", F.coalesce("component", "class").alias("component")), "jaccard-found")
    discard(of_class, every)
    # keys rise with ids, so the first of a component or class has its smallest id
    named = found.where("key = component").select("component", F.col("doc_id").alias("component_id"))
    classed = found.where("key = class").select("class", F.col("doc_id").alias("class_id"))
    out = found.join(named, "component").join(classed, "class")
    return out.select("mark", "doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", (F.col("key") == F.col("component")).alias("is_first"))
