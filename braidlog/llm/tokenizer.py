"""Byte-level BPE vocabularies read from a tokenizers JSON file, in the forms that the operators need."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

# The split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """What a byte-level BPE JSON file says: bytes of each id, merges with ranks, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letters = file["model"], byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special: dict[str, int] = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.id_of: dict[bytes, int] = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = raw(a), raw(b)
            self.merges[self.id_of[left], self.id_of[right]] = (rank, self.id_of[left + right])
        n = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * n
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()

    def ranked_by_id(self) -> bool:
        """Whether later merges have greater ids, so that ids can serve as ranks."""
        made = [i for _, (_, i) in sorted((r, (r, i)) for r, i in self.merges.values())]
        singles = max(self.id_of[bytes([b])] for b in range(256))
        return all(a < b for a, b in zip(made, made[1:])) and (not made or singles < made[0])


@lru_cache(maxsize=4)
def fast_encoder(path: str):
    """text -> ids as the tokenizers library gives without added tokens, as a uint32 array.

    tiktoken runs the same merges on the same vocabulary several times faster; where ids aren't
    ranks, and for a text that it refuses, the library itself encodes.
    """
    import tiktoken

    vocabulary = Vocabulary(path)

    @lru_cache(maxsize=1)
    def library():  # few texts need it, and it is held besides the other
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(path)
        out.no_padding()
        out.no_truncation()
        return out

    def by_library(text: str) -> np.ndarray:
        return np.array(library().encode(text, add_special_tokens=False).ids, np.uint32)

    if not vocabulary.ranked_by_id():
        return by_library
    quick = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=vocabulary.id_of, special_tokens=vocabulary.special)

    def encode(text: str) -> np.ndarray:
        try:
            return quick.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # a Rust panic isn't an Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return by_library(text)

    return encode
