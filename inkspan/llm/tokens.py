"""Token ids of a public byte-level BPE vocabulary.

The vocabulary is a parameter: the path of a ``tokenizers`` JSON file, which must
be readable on every executor.  Its merges are run by tiktoken from the very
ranks of that file, which gives the same ids several times faster (the tests hold
both against each other).  Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

END = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes for the code points from 256 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: the vocabulary's pattern without its look-ahead, which only runs of
#: two or more white-space characters need; without it the matcher is faster.
SINGLE_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_SPACE_RUN = re.compile(r"\s\s")


@lru_cache(2)
def encodings(path: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The vocabulary's encoding, and that for texts without runs of white space."""
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tuple(tiktoken.Encoding("byte_bpe", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (public_tokenizers.PATTERN, SINGLE_SPACED))


def vocabulary_size(path: str) -> int:
    return encodings(path)[0].n_vocab


def plain_ids(text: str | None, path: str) -> list[int]:
    """The ids of a text.  A null text is empty."""
    if not text:
        return []
    return encodings(path)[_SPACE_RUN.search(text) is None].encode_ordinary(text)


def document_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a document, then END."""
    return np.array([*plain_ids(text, path), END], "<u4")


def pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only one longer than capacity
    is cut, and then its first piece takes what the full ones leave."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]
