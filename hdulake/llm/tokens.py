"""Byte-level BPE ids, shared by packing and token counts.

The ids are those of the tokenizer file ``byte_bpe_50k.json``. The same vocabulary as ranks is read here because
its library encodes several times faster (the tests hold the two against each other). Texts of a corpus
hold too many distinct words for a memory of encoded ones to gain anything over encoding them anew.
"""

from __future__ import annotations

import base64
import sys
from array import array

_shared: dict[str | None, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit strings."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.core = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        ids = array("H", self.core.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def encoder(path: str | None = None) -> Encoder:
    """The worker's own encoder."""
    if path not in _shared:
        _shared[path] = Encoder(path)
    return _shared[path]
