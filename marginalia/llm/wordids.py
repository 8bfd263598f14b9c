"""Token ids of many texts with a word-based BPE vocabulary, one model call per distinct word.

The vocabulary's pre-tokenizer splits a normalised text into words that the model encodes one by
one, so ids depend on the word alone. Words are split and hashed as arrays of code points; only
words that are not in the (bounded) table of known words reach the model.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from . import text as t

KNOWN_WORDS = 400_000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Second and third code points of the two-letter and one-letter endings that follow an apostrophe.
_ONE = tuple(map(ord, "stmd"))
_TWO = (("r", "e"), ("v", "e"), ("l", "l"))


# The code points with Unicode's property White_Space.
_WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], dtype=np.uint8)
    table[list(_WHITE_SPACE)] = _SPACE
    return table


def _unassigned() -> np.ndarray:
    """Code points that Python's Unicode tables don't know; the tokenizer's may be newer."""
    table = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    table[list(_WHITE_SPACE)] = False
    return table


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: b for b in own}, **{b: 256 + i for i, b in enumerate(rest)}}


def _normal(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # Lower case is taken character by character, without the special final sigma.
    return text.replace("Σ", "σ").lower()


class WordIds:
    """Encoder for the vocabulary file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.classes, self.unassigned, self.alphabet = _classes(), _unassigned(), _byte_alphabet()
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, dtype=np.uint64)  # sorted hashes
        self.place = np.empty(0, dtype=np.int64)  # their words' numbers
        self.begin = np.zeros(1, dtype=np.int64)  # where the ids of word i begin
        self.ids = np.empty(0, dtype=np.int32)

    def _encode_word(self, word: str) -> list[int]:
        spelled = word.encode().decode("latin-1").translate(self.alphabet)
        return [x.id for x in self.model.tokenize(spelled)]

    def _learn(self, hashes: np.ndarray, spelled: list[str]) -> None:
        encoded = [self._encode_word(w) for w in spelled]
        sizes = np.array([len(e) for e in encoded], dtype=np.int64)
        n = len(self.begin) - 1
        self.ids = np.concatenate([self.ids, np.array([i for e in encoded for i in e], dtype=np.int32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        where = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, where, hashes)
        self.place = np.insert(self.place, where, n + np.arange(len(hashes)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the bounds of the texts.

        Texts with special tokens, or with characters newer than Python's Unicode tables, go to the tokenizer itself.
        """
        special = [i for i, x in enumerate(texts) if self.special.search(x) or self._newer(x)]
        plain = [_normal(x) for x in texts]
        for i in special:
            plain[i] = ""
        ids, first = self._encode_plain(plain)
        if not special:
            return ids, first
        parts = [ids[first[i] : first[i + 1]] for i in range(len(texts))]
        for i in special:
            parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _newer(self, text: str) -> bool:
        return not text.isascii() and bool(self.unassigned[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].any())

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        begin_of = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        start, end = self._split(points)
        if not len(start):
            return np.empty(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        up, down = t.powers(len(points))
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        h = t.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        distinct, example, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            spelled = [joined[a:b] for a, b in zip(start[example[new]].tolist(), end[example[new]].tolist(), strict=True)]
            self._learn(distinct[new], spelled)
        word = self.place[np.searchsorted(self.known, distinct)][inverse]
        sizes = self.begin[word + 1] - self.begin[word]
        ends = np.cumsum(sizes)
        take = np.repeat(self.begin[word] - (ends - sizes), sizes) + np.arange(ends[-1])
        bounds = np.searchsorted(start, begin_of)
        return self.ids[take], np.concatenate([[0], ends])[bounds]

    def _split(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word: letter runs, single numbers, runs of others, 's 't 're 've 'm 'll 'd."""
        kind = self.classes[points]
        some = kind != _SPACE
        begins = some.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        for i in np.flatnonzero((points[:-2] == 39) & begins[:-2] & (kind[1:-1] == _LETTER)).tolist():
            a, b = int(points[i + 1]), int(points[i + 2])
            n = 1 if a in _ONE else 2 if (chr(a), chr(b)) in _TWO else 0
            if n:
                begins[i + 1] = False
                begins[i + 1 + n] = kind[i + 1 + n] != _SPACE
        start = np.flatnonzero(begins)
        last = some.copy()
        last[:-1] &= begins[1:] | ~some[1:]
        return start, np.flatnonzero(last) + 1
