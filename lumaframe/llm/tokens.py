"""Token ids by the tokenizers library, with a bounded cache of the ids of pre-tokens.

The two public vocabularies merge pairs inside pre-tokens only. Where a text has nothing but the plain characters below,
the pre-tokens are cut here by the vocabulary's own pattern and the library's model is asked once for each different one;
any other text goes through the library as a whole. Both ways give the same ids, which the tests compare.
"""

from __future__ import annotations

import gc
import re
from functools import cache

import numpy as np

#: A process keeps the ids of so many pre-tokens and, unless told, of so many space-separated words, and of as many from before, at most.
CACHE_PIECES = 250_000

# ASCII and Latin-1 letters, the only letters and digits of plain texts, and the vocabularies' patterns over them.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\r !-~¡§«»¿{_L}]*")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+")
_MARKS = ",.;:!?)"
_BYTE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """Values by key; when it is full, those not asked for since it was last full are forgotten."""

    def __init__(self, most: int) -> None:
        self.old: dict[str, bytes] = {}
        self.most = most

    def make(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        """Keep what was asked for last only."""
        self.old = {}


class _Pieces(_Cache):
    """Ids of pre-tokens."""

    def __init__(self, tokenizer, most: int) -> None:
        super().__init__(most)
        table = _byte_characters()
        # All characters of plain texts, as what stands for their bytes.
        self.characters = {c: "".join(table[b] for b in chr(c).encode()) for c in range(256)}
        self.raw = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.model = tokenizer.model

    def make(self, piece: str) -> bytes:
        return self.ids(piece.translate(self.characters))

    def ids(self, characters: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(characters)])


class _Words(_Cache):
    """Ids of what stands between spaces, with the space before it in byte-level vocabularies, put together from its pre-tokens."""

    def __init__(self, cut, pieces: _Pieces, before: str, most: int) -> None:
        super().__init__(most)
        self.cut, self.pieces, self.before = cut, pieces, before
        self.stands = before.translate(pieces.characters)

    def make(self, word: str) -> bytes:
        # Words of plain texts only come here, where all that isalpha() means are the patterns' letters.
        if word.isalpha():
            return self.pieces.ids(self.stands + (word if word.isascii() else word.translate(self.pieces.characters)))
        # A word and one mark after it are two pre-tokens.
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return self[word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.cut(self.before + word)))


class Encoder:
    """encode(text) gives the uint32 ids of a whole text, without special tokens; a null or empty text has none."""

    def __init__(self, path: str, words: int = CACHE_PIECES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        self.cut = (_WORD if self.by_word else _BYTE).findall
        self.pieces = _Pieces(self.tokenizer, CACHE_PIECES)
        self.words = _Words(self.cut, self.pieces, "" if self.by_word else " ", words)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        self.pieces.trim()
        self.words.trim()
        if self.by_word:
            found = map(self.words.__getitem__, text.lower().split())
        elif "  " in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text:
            found = map(self.pieces.__getitem__, self.cut(text))
        else:
            words = text.split(" ")
            words[0] = b"".join(map(self.pieces.__getitem__, self.cut(words[0])))
            found = [words[0], *map(self.words.__getitem__, words[1:])]
        return np.frombuffer(b"".join(found), np.uint32)


    def end(self) -> None:
        """A task is over: the process keeps little until its next."""
        self.pieces.forget()
        self.words.forget()


@cache
def encoder(path: str, words: int = CACHE_PIECES) -> Encoder:
    """The process's encoder of a vocabulary, with a cache of so many words."""
    gc.set_threshold(100_000)  # the many short lists here hold no cycles
    return Encoder(path, words)
