"""Byte-level BPE vocabularies of the tokenizers library, encoded by the faster of two libraries.

Both give the same ids.  tiktoken is several times faster; its pattern backtracks over runs of white
space and gives up on runs of near a million, so texts with very long runs go to the tokenizers library.
"""
from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Split pattern of byte-level BPE (a fixed value of the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks in a row from which on a text is encoded by the tokenizers library.
LONG_RUN = 50_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """``special``: added tokens in a text, as ``<|endoftext|>``, get the ids of the file; else they are plain text."""

    def __init__(self, spec: bytes, special: bool):
        read = json.loads(spec)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in read["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in read["model"]["vocab"].items() if t not in added}
        self.special = special
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        self.spec = spec
        self._library: Tokenizer | None = None
        self.long_run = re.compile(r"\s{%d}" % LONG_RUN)
        self.token_bytes = [b""] * (1 + max([*ranks.values(), *added.values()]))
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.token_bytes[i] = t

    @property
    def library(self) -> Tokenizer:
        if self._library is None:
            self._library = Tokenizer.from_str(self.spec.decode())
            self._library.encode_special_tokens = not self.special
        return self._library

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and self.long_run.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.special:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return self.fast.encode_to_numpy(text, disallowed_special=())


    def encode_to_numpy(self, text: str, **special) -> np.ndarray:
        """tiktoken alone, with its own arguments for added tokens."""
        return self.fast.encode_to_numpy(text, **special)


@lru_cache(maxsize=4)
def byte_bpe(packed_file: bytes, special: bool) -> ByteBpe:
    """The encoder of a compressed vocabulary file, one per worker."""
    return ByteBpe(zlib.decompress(packed_file), special)
