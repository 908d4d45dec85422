"""Whole texts to token ids, with a memory for the pieces that repeat.

A byte-level or word-end pre-tokenizer never joins what stands on both sides of one space
between two non-space characters, nor a letter and the punctuation after it. Such pieces
(with the space in front) therefore encode alone to the same ids as within the text; a text
that may hold a special token is encoded whole. Before punctuation a text is cut only after
digits and Latin letters that normalisation leaves one letter: some letters, as the dotted
capital I, become a letter and a mark, which joins the punctuation. Each different piece is encoded once in a
worker; when the memory has ``KEPT`` of them, those that came most often stay. Pieces that are one word of
Latin letters go straight to the tokenizer's model, as its pre-tokenizer leaves them whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa

KEPT, AT_ONCE = 300_000, 4_096
_MARK = r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ſ])[!-/:-@\[-^`{-~]"
#: Pieces of a text: one word with the space before it, or all up to the next place to cut.
_PIECES = re.compile(rf" ?[^\W_]+(?={_MARK}| \S|\Z)|(?s:.)+?(?=(?<=\S) \S|{_MARK}|\Z)").findall
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_HELD: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Places(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.ends_words = bool(self.tokenizer.model.end_of_word_suffix)
        self.letters = _byte_letters()
        self.forget()
        tries = ["the", " the", " Thereof", " été", " Übergröße", " don", "s", " s", " ll", "naïve", " ÀÉÎõü", " x"]
        want = [e.ids for e in self.tokenizer.encode_batch(tries, add_special_tokens=False)]
        self.direct = [self._word(t) for t in tries] == want

    def forget(self) -> None:
        self.place = _Places()
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keep the half of the pieces that came most often, each twice at least."""
        often = np.flatnonzero(self.uses >= 2)
        often = often[np.argsort(-self.uses[often], kind="stable")][: KEPT // 2]
        often.sort()
        keys = list(self.place)
        start, n = self.ends[often], np.diff(self.ends)[often]
        stop = np.cumsum(n)
        self.ids = self.ids[np.repeat(start - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        self.ends = np.concatenate([[0], stop])
        self.uses = self.uses[often] // 2
        self.place = _Places((keys[i], j) for j, i in enumerate(often.tolist()))

    def _word(self, piece: str) -> list[int]:
        if self.lower:
            piece = unicodedata.normalize("NFC", piece).lower()
        if self.ends_words:
            piece = piece.lstrip(" ")
        if not piece.isascii() or piece[0] == " ":
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def _learn(self, new: list[str]) -> None:
        got: list[list[int] | None] = [self._word(k) if self.direct and _PLAIN(k) else None for k in new]
        rest = [i for i, ids in enumerate(got) if ids is None]
        for at in range(0, len(rest), AT_ONCE):
            some = rest[at : at + AT_ONCE]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([new[i] for i in some], add_special_tokens=False), strict=True):
                got[i] = e.ids
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))
        self.ids = np.concatenate([self.ids, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        if len(self.place) > KEPT:
            self._shrink()
        place, old = self.place, len(self.place)
        at = []
        for text in batch:
            keys = [text] if "<|" in text else _PIECES(text)
            at.append(np.fromiter(map(place.__getitem__, keys), np.int64, len(keys)))
        if grown := len(place) - old:
            self._learn(list(islice(reversed(place), grown))[::-1])
        self.uses = np.pad(self.uses, (0, grown)) + np.bincount(np.concatenate(at), minlength=len(place)) if at else self.uses
        out = []
        for p in at:
            start, n = self.ends[p], self.ends[p + 1] - self.ends[p]
            stop = np.cumsum(n)
            out.append(self.ids[np.repeat(start - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)])
        return out


def encoder(path: str) -> Encoder:
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]


def slices(ids: pa.Array, texts: pa.Array, most: int = 1 << 19, step: int = 256) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of ids and texts, of some ``most`` characters each, so that a batch of long texts stays small."""
    held: tuple[list[int], list[str]] = ([], [])
    size = 0
    for i in range(0, len(ids), step):
        for d, t in zip(ids[i : i + step].to_pylist(), texts[i : i + step], strict=True):
            text = t.as_py()
            held[0].append(d)
            held[1].append(text)
            size += len(text)
            if size > most:
                yield held
                held, size = ([], []), 0
    if held[0]:
        yield held
