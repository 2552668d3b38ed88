"""Byte-level BPE ids from a public vocabulary file.

The ids equal those of the ``tokenizers`` library for the same file, called with
``add_special_tokens=False`` (tests hold them against each other). The merges themselves run in
``tiktoken``, several times faster; texts that hold a special token's string, which the library
gives its own id, and texts with very long runs go through the library.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
#: Words or excess white space beyond this go to the slower library: there the fast encoder's pattern gets slow.
LONG_RUN = 2000


def default_path() -> str:
    return public_tokenizers.path(BYTE_BPE)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def has_long_run(text: str) -> bool:
    lengths = [len(w) for w in text.split()]
    return max(lengths, default=0) >= LONG_RUN or len(text) - sum(lengths) - len(lengths) >= LONG_RUN


class ByteBpe:
    """Encoder for one vocabulary file, as the library reads it: a special token's string has its id."""

    def __init__(self, path: str):
        symbols = byte_symbols()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(symbols[c] for c in word): i for word, i in vocab.items() if word not in special}
        self.size = max(max(vocab.values()), *special.values(), 0) + 1
        self.byte_len = np.zeros(self.size, np.int64)
        for word, i in [*ranks.items(), *((w.encode(), i) for w, i in special.items())]:
            self.byte_len[i] = len(word)
        self._blank = {i for word, i in ranks.items() if word[:1] == b" "}
        self._special = tuple(special)
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = path
        self._exact: Tokenizer | None = None

    def starts_with_blank(self, i: int) -> bool:
        return i in self._blank

    def encode(self, text: str) -> list[int]:
        if (len(text) >= LONG_RUN and has_long_run(text)) or any(s in text for s in self._special):
            if self._exact is None:
                self._exact = Tokenizer.from_file(self.path)
            return self._exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """The encoder of a worker process, loaded once."""
    return ByteBpe(path)
