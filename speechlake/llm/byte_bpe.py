"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

Every byte stands for one printable character, so a vocabulary entry of any bytes is a piece of text. The model holds
the entries in the order of their ranks with the negative rank as score, and does nothing to its input: no character
map, no added or removed spaces. Its merges then are those of the rank file: of all neighbours whose join is an entry
the one of the lowest rank, the leftmost of ties, is joined first. Texts are split by the pattern beforehand, and each
match goes through the model on its own; ids go back to bytes by the inverse map, so decoding loses nothing.

Matches are few against their occurrences: those up to ``KEPT`` characters are encoded once in a task, as long as no
more than ``MOST`` are held; longer ones are encoded where they stand.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.tokens import default_path

#: Characters of a match that is kept with its ids, and how many are held at most before all are forgotten.
KEPT, MOST = 48, 400_000
#: Matches of a text that are held at once.
WINDOW = 500_000


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable and no space, else the next free one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file by rising rank; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        entries = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, f)}
    if sorted(entries) != list(range(len(entries))):
        raise ValueError(f"the ranks of {path} are not gapless from 0")
    return [entries[i] for i in range(len(entries))]


def model_bytes(entries: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the unknown piece, which no text meets, comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars, model = byte_characters(), pb.ModelProto()
    kinds = pb.ModelProto.SentencePiece
    for rank, entry in enumerate(entries):
        model.pieces.add(piece="".join([chars[b] for b in entry]), score=-float(rank), type=kinds.NORMAL)
    model.pieces.add(piece="<unk>", score=-float(len(entries)), type=kinds.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size = pb.TrainerSpec.BPE, len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(entries), -1, -1, -1
    spec.byte_fallback = False
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class ByteBpe:
    """A rank file's encoder and decoder. ``model`` may be a serialised model of the same entries."""

    def __init__(self, path: str, pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.raw = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model or model_bytes(self.raw))
        self.chars = dict(enumerate(byte_characters()))
        self.kept: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, so many at a time."""
        if len(text) <= WINDOW:
            yield self.pattern.findall(text)
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(matches, WINDOW)):
            yield some

    def _through_model(self, tokens: list[str]) -> list[bytes]:
        """The ids of each match, as little-endian unsigned 32-bit integers."""
        mapped = [t.encode("utf-8").decode("latin-1").translate(self.chars) for t in tokens]
        return [np.asarray(ids, "<u4").tobytes() for ids in self.model.encode(mapped, num_threads=1)]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        out = []
        for tokens in self.pre_tokens(text):
            if len(self.kept) > MOST:
                self.kept.clear()
            distinct = dict.fromkeys(tokens)
            short = [t for t in distinct if len(t) <= KEPT and t not in self.kept]
            self.kept.update(zip(short, self._through_model(short)))
            long = [t for t in distinct if len(t) > KEPT]
            own = dict(zip(long, self._through_model(long)))
            out += [self.kept[t] if len(t) <= KEPT else own[t] for t in tokens] if own else map(self.kept.__getitem__, tokens)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids; an id outside the vocabulary is an error."""
        if len(ids) and (int(ids.max()) >= len(self.raw) or int(ids.min()) < 0):
            raise ValueError("an id outside the vocabulary")
        raw = self.raw.__getitem__
        return b"".join([b"".join(map(raw, ids[lo : lo + WINDOW].tolist())) for lo in range(0, len(ids), WINDOW)])


@cache
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _coder(path: str | None, pattern: str | None) -> Callable[[], ByteBpe]:
    """What a task calls for its coder; one for each Python worker."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    where = path or default_path("byte_bpe_50k.tiktoken")
    return lambda: coder(where, pattern)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _added(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch's ids, as they are, beside new columns."""
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], names=["doc_id", *columns])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids of every row. A null text is the empty one and has no ids; rows without an id and repeated rows are encoded like any other, and other columns, whatever their names, are left out."""
    get = _coder(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(get().encode(t), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
            yield _added(batch, ids=pa.array(ids, pa.list_(pa.int32())))

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes from doc_id, ids. Null ids give null; bytes that are no whole characters stay as they are."""
    get = _coder(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [get().decode(x.values.to_numpy()) if x.is_valid else None for x in batch.column("ids")]
            yield _added(batch, bytes=pa.array(raw, pa.binary()))

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def digest_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of every row: encoded, decoded again from the ids alone, and both digested, a text at a time. Rows as in encode."""
    get = _coder(path, pattern)

    def one(text: str) -> tuple[int, str, str, int]:
        ids = get().encode(text)
        raw = get().decode(np.frombuffer(ids, "<u4"))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, raw, size = zip(*map(one, batch.column("text").to_pylist())) if batch.num_rows else ((),) * 4
            yield _added(batch, n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids, pa.string()), decoded_sha256=pa.array(raw, pa.string()), n_bytes=pa.array(size, pa.int64()))

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
