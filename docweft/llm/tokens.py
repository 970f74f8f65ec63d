"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Where the vocabulary files lie; a parameter of every operator that needs it.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How that vocabulary's encoder cuts texts before merging bytes. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE = 300_000


@lru_cache(2)
def encoder(folder: str = TOKENIZERS):
    import tiktoken

    with open(os.path.join(folder, VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """Counts tokens exactly, remembering the count of each blank-separated chunk.

    The encoder never joins characters across the front of a space that follows a visible character, so the count of a
    text is the sum of the counts of its chunks, each with the space before it.
    """

    def __init__(self, folder: str = TOKENIZERS):
        super().__init__()
        self.encode = encoder(folder).encode_ordinary

    def __missing__(self, chunk: str) -> int:
        n = len(self.encode(" " + chunk))
        if len(chunk) < 64:
            if len(self) >= _CACHE:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        chunks = text.split(" ")
        if "  " in text or "\n " in text or any(c and c[-1] <= " " for c in chunks) or not text.isascii():
            # chunks that begin after a blank belong to the chunk before
            joined = [chunks[0]]
            for c in chunks[1:]:
                last = joined[-1]
                if not last or last[-1] <= " " or last[-1].isspace() or last[-1] in "\x85\x1c\x1d\x1e\x1f":
                    joined[-1] = last + " " + c
                else:
                    joined.append(c)
            chunks = joined
        return len(self.encode(chunks[0])) + sum(map(self.__getitem__, chunks[1:]))
