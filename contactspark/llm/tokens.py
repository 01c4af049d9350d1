"""Token ids of whole texts by a public byte-level vocabulary; the file's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "byte_bpe_50k.json"
# fixed values of the vocabulary's description: its one special token
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def path_of(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """Ids as the library for the ``.json`` form of the same vocabulary gives them (see the tests), several times faster."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def ids_of(text: str, path: str) -> np.ndarray:
    """Ids of one text as unsigned 32-bit numbers; the special string is its one id, as that library's default has it."""
    known = encoder(path)
    ids = known.encode(text, allowed_special="all") if SPECIAL in text else known.encode_ordinary(text)
    return np.array(ids, dtype="<u4")
