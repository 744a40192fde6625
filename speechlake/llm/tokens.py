"""Token ids of the public byte-level BPE vocabulary, by a fast reader of the same vocabulary."""

from __future__ import annotations

import base64
from functools import cache

SPECIAL = "<|endoftext|>"
#: Pieces of a batch that the encoder takes at once, in characters: bounds what one call holds.
EOD = 50256


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def fast_encoder(path: str):
    """An encoder over the rank file; it gives the ids of the JSON file's tokenizer (tests compare them)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, rank_path: str | None = None, json_path: str | None = None) -> list[int]:
    """Ids of a whole text, as the JSON file's tokenizer gives them with add_special_tokens=False.

    That tokenizer turns the end-of-text string in a text into its own id; such texts go to it, all others to the
    faster reader of the same vocabulary.
    """
    if SPECIAL in text:
        return json_tokenizer(json_path or default_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    return fast_encoder(rank_path or default_path("byte_bpe_50k.tiktoken")).encode_ordinary(text)


def encode_plain(text: str, rank_path: str | None = None) -> list[int]:
    """Ids of a whole text in which the end-of-text string is text like any other, so that no id of a text is EOD."""
    return fast_encoder(rank_path or default_path("byte_bpe_50k.tiktoken")).encode_ordinary(text)
