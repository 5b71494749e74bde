"""Byte-level BPE ids, as the `tokenizers` library gives them.

The public vocabulary is one and the same in its two files; tiktoken reads the
rank file and yields the same ids several times faster (the tests hold the two
libraries against each other). The file's place is a parameter.
"""

from __future__ import annotations

import base64
import functools

#: The string that the vocabulary's JSON file marks as one special id.
END_OF_TEXT = {"byte_bpe_50k": {"<|endoftext|>": 50256}}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@functools.lru_cache(maxsize=4)
def encoder(name: str, path: str | None = None):
    """An encoder for a vocabulary by name; path overrides its file."""
    import public_tokenizers
    import tiktoken

    with open(path or vocabulary_path(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=END_OF_TEXT.get(name, {}))


def ids_of(name: str, text: str | None) -> list[int]:
    """Ids of a text, no special tokens added; null is empty."""
    return encoder(name).encode(text, allowed_special="all") if text else []
