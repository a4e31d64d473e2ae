"""Token ids of whole texts with a public BPE vocabulary, cached by word.

The vocabulary's pre-tokenizer splits lower-cased text into words and never joins across white space. A
text of Latin-1 characters is split by the same pattern here, and every distinct word is given to the
library's BPE model once. Any other text is taken chunk by chunk, between white space, and chunks with
other characters pass the whole tokenizer.
"""

from __future__ import annotations

import struct

import regex
from tokenizers import Tokenizer

CACHE_WORDS = 300_000
# What the vocabulary file states as its word pattern, and the control
# characters that Python takes for white space while the library does not.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NOT_SPACES = "\x1c\x1d\x1e\x1f"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class WordTokens:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(WORD_PATTERN).findall
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if _plain_latin(text):
            return self._words(text)
        chunks = regex.findall(r"[^ \t\n\r]+", text)
        return b"".join(self._words(c) if _plain_latin(c) else self._library(c) for c in chunks)

    def _words(self, text: str) -> bytes:
        words, known = self.split(text.lower()), self.words
        for word in set(words).difference(known):
            known[word] = self.older.get(word) or self._word(word)
        ids = b"".join(map(known.__getitem__, words))
        if len(known) > CACHE_WORDS:
            # Words seen since the last turn are kept for another one.
            self.older, self.words = known, {}
        return ids

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isalnum()):
            word = word.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.tokenizer.model.tokenize(word)])

    def _library(self, chunk: str) -> bytes:
        return _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)


def _plain_latin(text: str) -> bool:
    """Latin-1 without special tokens or odd control characters: lower case and words are the library's."""
    if "<|" in text or any(c in text for c in NOT_SPACES):
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)
