"""Token ids of a public byte-pair vocabulary, chunk by chunk with a bounded memory.

The vocabulary file is an argument. Its normaliser lower-cases and drops white space, and no
merge crosses white space, so the ids of a text are those of its white-space separated chunks
one after the other. A chunk of plain Latin letters, digits and marks is merged by rank
directly; any other chunk (and any text with the separators \\x1c-\\x1f, which the vocabulary
does not take for white space) goes through the tokenizer itself, so the ids are always its.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

from vigilframe.llm.words import Memo

# The vocabulary's split pattern, its mark of a word's end, its special tokens' opening.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
SPECIAL = "<|"
END_BYTE = b"\xff"  # never part of UTF-8; stands for the word-end mark
PLAIN_LIMIT = 0x250  # below it, lower-casing and normal forms need no table
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def printable_bytes() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ChunkTokens:
    """Little-endian 32-bit ids of chunks and texts."""

    def __init__(self, path: str, most: int = 200_000):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        back = printable_bytes()
        ranks = {}
        for token, rank in vocab.items():
            ends = token.endswith(WORD_END) and token != WORD_END
            stem = token[: -len(WORD_END)] if ends else token
            if all(c in back for c in stem):
                ranks[bytes(back[c] for c in stem) + END_BYTE * ends] = rank
        self.merge = tiktoken._tiktoken.CoreBPE(ranks, {}, SPLIT).encode_single_piece
        self.pieces = regex.compile(SPLIT).findall
        self.plain = regex.compile(f"[!-{chr(PLAIN_LIMIT - 1)}]+").fullmatch
        self.memo = Memo(self.chunk, most)

    def chunk(self, chunk: str) -> bytes:
        if not self.plain(chunk) or SPECIAL in chunk:
            return self.direct(chunk)
        lower = chunk.lower()
        if lower.isalpha():
            ids = self.merge(lower.encode() + END_BYTE)
        else:
            ids = [i for p in self.pieces(lower) for i in self.merge(p.encode() + END_BYTE)]
        return array("I", ids).tobytes()

    def direct(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        if any(s in text for s in ODD_SPACE):
            return self.direct(text)
        return b"".join(map(self.memo.__getitem__, text.split()))


@lru_cache(maxsize=1)
def chunk_tokens(path: str) -> ChunkTokens:
    """One for each Python worker."""
    return ChunkTokens(path)
