"""Subword encoding with seeded merge-dropout, and its decoding.

Segmentation follows merges: neighbouring symbols whose join is a piece are candidates, the candidate with the best
score (the leftmost of ties) leaves the agenda first, and a keyed hash of the candidate may skip it for good. The key
holds the seed, the document, the chunk's place in the document and the symbol's place in the chunk, so every
occurrence of a chunk is sampled on its own, and a run can be repeated on any cluster. No piece has a space mark after
another character, so merges never cross the start of a run of spaces. What is kept between documents is no sample:
the candidates that a short chunk meets, and its symbols, after any sequence of skips; which of them an occurrence
skips is drawn for it alone. Characters outside the vocabulary become byte pieces, so decoding loses nothing.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.llm.tokens import default_path

SPACE = "\u2581"
#: Stands for a space mark that is in the text itself; no valid text holds a lone surrogate.
LITERAL = "\udc81"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Chunks above this many characters are segmented by a heap, one at a time.
LONG = 200
#: Chunks up to this many characters are drawn from kept candidates, while a skip is no likelier than SELDOM.
SHORT, SELDOM = 24, 0.2
#: Characters of text that are segmented together.
BATCH_CHARS = 4_000_000
#: Characters of longer chunks that are segmented together.
ROUND_CHARS = 1_000_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Vocabulary:
    """Pieces, scores and the table of merges of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        ids = {self.pieces[i]: i for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        places = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = np.array([places.get(sp.get_score(i), 0) for i in range(n)], np.int64)
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.merge = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        keys = np.array([a * n + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.n, self.keys, self.joined = n, keys[order], np.array(list(self.merge.values()), np.int64)[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The join of each pair, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], -1)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def mixed(key: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The keyed hash of a candidate: chunk key, place of its left symbol in the chunk, and joined piece."""
    with np.errstate(over="ignore"):
        x = key + _M1 * place.astype(np.uint64) + _M2 * piece.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def chunk_key(chunk: str, seed: int, variant: int) -> int:
    return xxhash.xxh64_intdigest(chunk.encode("utf-8", "surrogatepass"), seed=(seed * 1_000_003 + variant) % (1 << 64))


def document_key(seed: int, variant: int) -> int:
    return chunk_key("", seed, variant)


def _mixed_one(key: int, place: int, piece: int) -> int:
    """mixed() of single numbers."""
    most = (1 << 64) - 1
    x = (key + int(_M1) * place + int(_M2) * piece) & most
    x = ((x ^ (x >> 30)) * int(_M2)) & most
    x = ((x ^ (x >> 27)) * int(_M3)) & most
    return x ^ (x >> 31)


def by_heap(v: Vocabulary, chunk: str, key: int, limit: int) -> list[int]:
    """One chunk's symbols (below zero: a character without a piece), with a heap as the agenda."""
    return _by_agenda(v, chunk, lambda a, j: limit > 0 and _mixed_one(key, a, j) < limit)


def traced(v: Vocabulary, chunk: str, skips: tuple[int, ...]) -> tuple[list[int], list[tuple[int, int]]]:
    """A chunk's symbols if the candidates of these numbers, in the order of the agenda, are skipped; and the (place, piece) of those that come after the last of them."""
    met: list[tuple[int, int]] = []

    def skip(a: int, j: int) -> bool:
        met.append((a, j))
        return len(met) - 1 in skips

    ids = _by_agenda(v, chunk, skip)
    return ids, met[skips[-1] + 1 if skips else 0 :]


def _by_agenda(v: Vocabulary, chunk: str, skip: Callable[[int, int], bool]) -> list[int]:
    ids = [int(v.single[ord(c)]) if v.single[ord(c)] >= 0 else -1 - ord(c) for c in chunk]
    left, right, version = [i - 1 for i in range(len(ids))], [i + 1 for i in range(len(ids))], [0] * len(ids)
    heap: list[tuple] = []

    def offer(a: int) -> None:
        b = right[a]
        if a >= 0 and b < len(ids) and (j := v.merge.get((ids[a], ids[b]))) is not None:
            heapq.heappush(heap, (int(v.rank[j]), a, j, version[a], version[b]))

    for a in range(len(ids) - 1):
        offer(a)
    while heap:
        _, a, j, va, vb = heapq.heappop(heap)
        b = right[a]
        if version[a] != va or b >= len(ids) or version[b] != vb:
            continue
        if skip(a, j):
            continue
        ids[a], right[a], version[a], version[b] = j, right[b], va + 1, -1
        if right[b] < len(ids):
            left[right[b]] = a
        if left[a] >= 0:
            offer(left[a])
        offer(a)
    out, a = [], 0
    while a < len(ids):
        out.append(ids[a])
        a = right[a]
    return out


def by_rounds(v: Vocabulary, chunks: list[str], keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All chunks at once: in each round every chunk takes its agenda's first candidate. Symbols, and their number by chunk."""
    def skips(turn: int, own: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray | None:
        return mixed(keys[own], place, piece) < np.uint64(limit) if limit else None

    return _in_rounds(v, chunks, skips)


def traced_all(v: Vocabulary, chunks: list[str], skips: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """traced() of many chunks at once: symbols, their number by chunk, rows (place, piece) of the candidates after the last skip, and their number by chunk.

    A round takes one candidate of every chunk, so the number of a candidate is that of its round.
    """
    owner = np.repeat(np.arange(len(chunks)), [len(k) for k in skips])
    number = np.array([x for k in skips for x in k], np.int64)
    last = np.array([k[-1] if k else -1 for k in skips], np.int64)
    at = {int(t): owner[number == t] for t in np.unique(number)}
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def skip(turn: int, own: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray | None:
        late = turn > last[own]
        seen.append((own[late], place[late], piece[late]))
        if turn not in at:
            return None
        hit = np.zeros(len(chunks), bool)
        hit[at[turn]] = True
        return hit[own]

    ids, sizes = _in_rounds(v, chunks, skip)
    own, place, piece = (np.concatenate(x) for x in zip(*seen)) if seen else (np.zeros(0, np.int64),) * 3
    order = np.argsort(own, kind="stable")
    return ids, sizes, np.stack([place[order], piece[order]], axis=1), np.bincount(own, minlength=len(chunks))


def _in_rounds(v: Vocabulary, chunks: list[str], skips: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(c) for c in chunks], np.int64)
    if not len(chunks):
        return np.zeros(0, np.int64), sizes
    code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ids = v.single[code].astype(np.int64)
    ids = np.where(ids < 0, -1 - code, ids)
    own = np.repeat(np.arange(len(chunks)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined = np.full(len(ids), -1, np.int64)
    same = own[:-1] == own[1:]
    joined[:-1] = np.where(same, v.look_up(ids[:-1], ids[1:]), -1)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    far, turn = np.int64(1) << 62, -1
    while len(ids):
        turn += 1
        order = np.where(joined < 0, far, (v.rank[joined] << 24) + place)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        best = np.minimum.reduceat(order, first)
        live = np.repeat(best < far, np.diff(np.append(first, len(ids))))
        if not live.all():
            done.append((own[~live], ids[~live]))
            ids, own, place, joined, order = (x[live] for x in (ids, own, place, joined, order))
            if not len(ids):
                break
            best = best[best < far]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        at = np.flatnonzero(order == np.repeat(best, np.diff(np.append(first, len(ids)))))
        skip = skips(turn, own[at], place[at], joined[at])
        if skip is not None:
            joined[at[skip]] = -1
            at = at[~skip]
        ids[at] = joined[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        moved = (np.cumsum(keep) - 1)[at]
        ids, own, place, joined = ids[keep], own[keep], place[keep], joined[keep]
        for i in (moved, moved - 1):
            i = i[i >= 0]
            j = np.minimum(i + 1, len(ids) - 1)
            joined[i] = np.where((own[i] == own[j]) & (j > i), v.look_up(ids[i], ids[j]), -1)
    own, ids = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(own, kind="stable")
    return ids[order], np.bincount(own, minlength=len(chunks))


def with_bytes(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters without a piece by byte pieces."""
    if not (ids < 0).any():
        return ids, sizes
    odd = {int(x): [v.byte_id[b] for b in (SPACE if -1 - x == ord(LITERAL) else chr(-1 - x)).encode("utf-8", "surrogatepass")] for x in np.unique(ids[ids < 0])}
    reps = np.ones(len(ids), np.int64)
    at = np.flatnonzero(ids < 0)
    reps[at] = [len(odd[int(x)]) for x in ids[at]]
    out = np.repeat(ids, reps)
    out[out < 0] = [b for x in ids[at] for b in odd[int(x)]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return out, np.bincount(owner, reps, len(sizes)).astype(np.int64)


class _Column:
    """A growing array."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(self.n, len(values)), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Encoder:
    """Encodes texts, and keeps what it knows of chunks until there is too much.

    A node is a chunk with a sequence of skips: its symbols, and the candidates that it meets after the last skip. An
    occurrence starts at its chunk's node without skips and draws for each candidate; at the first that it skips it
    goes on to that candidate's node.
    """

    def __init__(self, v: Vocabulary, seed: int, dropout: float, most: int = 1_000_000):
        self.v, self.seed, self.most = v, seed, most
        self.limit = min(int(dropout * 2.0**64), (1 << 64) - 1)
        self.short = SHORT if dropout <= SELDOM else 0
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.chunk: list[str] = []
        self.skips: list[tuple[int, ...]] = []
        self.ids, self.starts, self.n = _Column(np.int32), _Column(np.int64), _Column(np.int32)
        self.place, self.piece, self.child = _Column(np.int32), _Column(np.int32), _Column(np.int32)
        self.first, self.met = _Column(np.int64), _Column(np.int32)

    def segment(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        short = [i for i, c in enumerate(chunks) if len(c) <= LONG]
        ids, n = by_rounds(self.v, [chunks[i] for i in short], keys[short], self.limit)
        if len(short) < len(chunks):
            parts = dict(zip(short, np.split(ids, np.cumsum(n)[:-1])))
            whole = [parts[i] if i in parts else np.array(by_heap(self.v, c, int(keys[i]), self.limit), np.int64) for i, c in enumerate(chunks)]
            ids, n = np.concatenate(whole), np.array([len(x) for x in whole], np.int64)
        return with_bytes(self.v, ids, n)

    def add(self, chunks: list[str], skips: list[tuple[int, ...]], roots: bool = False) -> None:
        """New nodes. With dropout, long chunks have neither symbols nor candidates here."""
        n, met, both = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), np.zeros((0, 2), np.int64)
        if self.limit:
            short = [i for i, c in enumerate(chunks) if len(c) <= self.short]
            ids, sizes, both, met[short] = traced_all(self.v, [chunks[i] for i in short], [skips[i] for i in short])
            ids, n[short] = with_bytes(self.v, ids, sizes)
        else:
            ids, n = self.segment(chunks, np.zeros(len(chunks), np.uint64))
        self.starts.extend(self.ids.n + np.cumsum(n) - n)
        self.first.extend(self.place.n + np.cumsum(met) - met)
        self.ids.extend(ids)
        self.n.extend(n)
        self.met.extend(met)
        self.place.extend(both[:, 0])
        self.piece.extend(both[:, 1])
        self.child.extend(np.full(len(both), -1))
        if roots:
            self.seen.update(zip(chunks, range(len(self.chunk), len(self.chunk) + len(chunks))))
        self.chunk += chunks
        self.skips += skips

    def draw(self, node: np.ndarray, keys: np.ndarray) -> None:
        """Move every occurrence to the node of the candidates that it skips."""
        at = np.arange(len(node))
        while len(at):
            size = self.met.held[node[at]]
            flat = _ranges(self.first.held[node[at]], size)
            own = np.repeat(at, size)
            hit = np.flatnonzero(mixed(keys[own], self.place.held[flat], self.piece.held[flat]) < np.uint64(self.limit))
            hit = hit[np.concatenate([[True], own[hit][1:] != own[hit][:-1]])] if len(hit) else hit
            at, flat = own[hit], flat[hit]
            new, where = np.unique(flat, return_index=True)
            missing = self.child.held[new] < 0
            new, parents = new[missing], node[at[where[missing]]]
            if len(new):
                number = len(self.chunk) + np.arange(len(new))
                after = [(k[-1] + 1 if k else 0) for k in (self.skips[p] for p in parents)]
                self.child.held[new] = number
                self.add([self.chunk[p] for p in parents], [(*self.skips[p], a + int(x)) for p, a, x in zip(parents, after, new - self.first.held[parents])])
            node[at] = self.child.held[flat]

    def __call__(self, texts: list[str], variants: list[int]) -> list[np.ndarray]:
        if len(self.chunk) > self.most:
            self.forget()
        listed = [_CHUNK.findall(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
        counts = np.array([len(x) for x in listed], np.int64)
        chunks = [c for own in listed for c in own]
        self.add(new := [c for c in dict.fromkeys(chunks) if c not in self.seen], [()] * len(new), roots=True)
        node = np.fromiter(map(self.seen.__getitem__, chunks), np.int64, len(chunks))
        ids, starts, n = self.ids.held, self.starts.held, self.n.held
        if self.limit:
            owner = np.array([document_key(self.seed, x) for x in variants], np.uint64)
            nth = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts)
            keys = mixed(np.repeat(owner, counts), nth, np.zeros(len(node), np.int64))
            long = np.fromiter(map(len, chunks), np.int64, len(chunks)) > self.short
            at = np.flatnonzero(~long)
            moved = node[at]
            self.draw(moved, keys[at])
            node[at] = moved
            ids, starts, n = self.ids.held, self.starts.held[node], self.n.held[node].astype(np.int64)
            if long.any():
                at = np.flatnonzero(long)
                size = np.fromiter((len(chunks[i]) for i in at), np.int64, len(at))
                done = [self.segment([chunks[i] for i in some], keys[some]) for some in np.split(at, np.flatnonzero(np.diff(np.cumsum(size) // ROUND_CHARS)) + 1)]
                n[at] = np.concatenate([x for _, x in done])
                starts[at] = self.ids.n + np.cumsum(n[at]) - n[at]
                ids = np.concatenate([ids[: self.ids.n], *[x.astype(np.int32) for x, _ in done]])
        else:
            starts, n = starts[node], n[node].astype(np.int64)
        whole = ids[_ranges(starts, n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        return np.split(whole, ends[:-1])


@cache
def encoder(path: str, seed: int, dropout: float) -> Encoder:
    return Encoder(vocabulary(path), seed, dropout)


def encode_texts(v: Vocabulary, texts: list[str], variants: list[int], seed: int, dropout: float) -> list[np.ndarray]:
    """The piece ids of each text."""
    return Encoder(v, seed, dropout)(texts, variants)


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of a sequence of ids; the space that encoding puts before a text is taken away."""
    raw = v.raw
    text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")
    return text[1:] if text.startswith(" ") else text


def variant_of(id_col: Column, text: Column, seed: int, variants: int | None) -> Column:
    """A document's part of the key, from its id (without one, from its text): all 64 bits, or one of so many variants."""
    own = F.when(id_col.isNull(), F.xxhash64(text, F.lit(seed))).otherwise(F.xxhash64(id_col, F.lit(seed)))
    return own if variants is None else F.pmod(own, F.lit(variants)).cast("long")


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 1, variants: int | None = None, model_path: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, variant, ids (or, with digest, n_chars, n_pieces, ids_crc32 and lossless) of every row.

    Every document has its own variant, unless there are to be only so many. A null or empty text has no pieces. A
    row without an id has its text's variant. Repeated rows give equal results; other columns are ignored.
    """
    path = model_path or default_path("piece_bpe_32k.model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, run_encoder = vocabulary(path), encoder(path, seed, dropout)
        for pdf in batches:
            lo, size = 0, 0
            lengths = pdf["text"].str.len().tolist()
            for hi in range(len(pdf)):
                size += lengths[hi]
                if size < BATCH_CHARS and hi + 1 < len(pdf):
                    continue
                some = pdf.iloc[lo : hi + 1]
                lo, size = hi + 1, 0
                ids = run_encoder(some["text"].tolist(), some["variant"].tolist())
                out = pd.DataFrame({"doc_id": some["doc_id"].array, "variant": some["variant"].array})
                if digest:
                    out["n_chars"] = some["text"].str.len().array
                    out["n_pieces"] = [len(x) for x in ids]
                    out["ids_crc32"] = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    out["lossless"] = [decode_ids(v, x) == t for x, t in zip(ids, some["text"])]
                else:
                    out["ids"] = [x.tolist() for x in ids]
                yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), variant_of(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), seed, variants).alias("variant"))
    return rows.mapInPandas(run, "doc_id long, variant long, " + ("n_chars long, n_pieces long, ids_crc32 long, lossless boolean" if digest else "ids array<int>"))


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give a null text."""
    path = model_path or default_path("piece_bpe_32k.model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": [None if x is None else decode_ids(v, np.asarray(x, np.int64)) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
