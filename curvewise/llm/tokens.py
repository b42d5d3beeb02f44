"""Token ids of whole texts by a public byte-level vocabulary, with a cache of pieces.

A text is cut before every space that a non-space follows. The vocabulary's own splitting
never puts such a space inside a pre-token, so each piece can be encoded alone, and a piece
that was seen before costs one look-up.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: Caches are emptied when they hold this many pieces.
CACHE_PIECES = 400_000
#: Longer pieces are encoded without being kept.
CACHE_CHARS = 64
_GAP = re.compile(r" (?=\S)")
_ODD = re.compile(r" \s")


def default_paths() -> tuple[str, str]:
    """The vocabulary for `tokenizers` and its ranks for `tiktoken`."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(text: str) -> list[str]:
    """The text's pieces; all but the first lack the space that leads them."""
    parts = text.split(" ")
    if "" in parts[1:] or _ODD.search(text):
        parts = _GAP.split(text)
    return parts


class Encoder:
    """ids(text) as little-endian uint16 bytes; counts(text) as numbers of ids by piece."""

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.full = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        if max(table.values()) >= 2**16:
            raise ValueError("ids do not fit in 16 bits")
        self.first, self.later = _Pieces(self._ids, ""), _Pieces(self._ids, " ")
        self.first_n, self.later_n = _Pieces(self._count, ""), _Pieces(self._count, " ")

    def _ids(self, piece: str) -> bytes:
        return np.array(self.fast.encode_ordinary(piece), np.uint16).tobytes()

    def _count(self, piece: str) -> int:
        return len(self.fast.encode_ordinary(piece))

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def ids(self, text: str) -> bytes:
        if self.has_special(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()
        parts = pieces(text)
        return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))

    def counts(self, parts: list[str]) -> np.ndarray:
        out = np.empty(len(parts), np.int64)
        out[0] = self.first_n[parts[0]]
        out[1:] = np.fromiter(map(self.later_n.__getitem__, parts[1:]), np.int64, len(parts) - 1)
        return out


class _Pieces(dict):
    def __init__(self, make, lead: str):
        super().__init__()
        self.make, self.lead = make, lead

    def __missing__(self, piece: str):
        value = self.make(self.lead + piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = value
        return value


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(vocabulary, ranks)
