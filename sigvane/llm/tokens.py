"""Token ids of whole texts by a public byte-level vocabulary.

The ids are those the vocabulary's ``tokenizers`` file gives; they are computed from the same vocabulary kept as ranks,
which the tests hold equal, because that takes a fifth of the time.
"""

from __future__ import annotations

import base64

import public_tokenizers
import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}  # fixed value of the vocabulary


class ByteTokenizer:
    """Encodes a text to little-endian unsigned 32-bit ids.  ``path`` names the ranks file."""

    def __init__(self, path: str | None = None):
        with open(path or public_tokenizers.path(RANKS), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if text else b""


_LOADED: dict[str | None, ByteTokenizer] = {}


def loaded(path: str | None = None) -> ByteTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]
