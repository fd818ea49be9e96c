"""A byte-level BPE tokenizer file: splitting of texts, merges of one word, bytes
of the ids. Results are those of the ``tokenizers`` library.

Texts are split by the tokenizer's own expression. Where all characters are below
U+0250 an equal expression of the standard library serves; a text with a character
that Unicode 3.2 lacks is split by the library itself, as its tables and those of
the regex module differ there.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable
from functools import cache

import numpy as np

#: fixed value: how the tokenizer splits a text
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOW = 0x250
_GAP, _ODD = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")


def _range_of(kind: str) -> str:
    """The characters below _LOW of a regex class, as the inside of a set."""
    import regex

    return "".join(re.escape(chr(c)) for c in range(_LOW) if regex.fullmatch(kind, chr(c)))


@cache
def _low_split() -> tuple[re.Pattern, re.Pattern]:
    space, letter, digit = _range_of(r"\s"), _range_of(r"\p{L}"), _range_of(r"\p{N}")
    split = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")
    return re.compile(f"[\0-{chr(_LOW - 1)}]*"), split


@cache
def _old(char: str) -> bool:
    return unicodedata.ucd_3_2_0.category(char) != "Cn"


class ByteBpe:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        moved = [b for b in range(256) if b not in kept]
        of_char = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(moved)}
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        size = max(max(vocab.values()), *self.specials.values(), 0) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(of_char[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode("utf-8")
        self.chars = [c for c, _ in sorted(of_char.items(), key=lambda x: x[1])]
        library = Tokenizer.from_file(path)
        self.model, self.library, self.general = library.model, library.pre_tokenizer, regex.compile(SPLIT)
        self.low, self.low_split = _low_split()

    def parts(self, text: str) -> list[str]:
        """Stretches of plain text and special tokens in turn, plain text first."""
        return self.special.split(text) if self.special else [text]

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens; together they are the text."""
        if self.low.fullmatch(text):
            return self.low_split.findall(text)
        if all(map(_old, set(text))):
            return self.general.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def chunks(self, text: str) -> list[str]:
        """The text cut before each space that no white space follows, where the
        expression always cuts. The first chunk is marked by a space before it;
        the others are given without the space they begin with."""
        head, *rest = _GAP.split(text) if _ODD.search(text) else text.split(" ")
        return [" " + head, *rest]

    def words(self, chunks: Iterable[str]) -> tuple[list[str], list[str], np.ndarray]:
        """The chunks, first ones before others, their words, and words per chunk."""
        heads, others = [], []
        for c in chunks:
            (heads if c[:1] == " " else others).append(c)
        words, size = [], []
        for h in heads:
            own = self.split(h[1:])
            words += own
            size.append(len(own))
        whole = " " + " ".join(others) if others else ""
        if others and self.low.fullmatch(whole):
            own = self.low_split.findall(whole)
            ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)))
            stop = np.cumsum(np.fromiter(map(len, others), dtype=np.int64, count=len(others)) + 1)
            words += own
            size = np.concatenate((np.array(size, dtype=np.int64), np.diff(np.searchsorted(ends, stop, side="right"), prepend=0)))
        else:
            for c in others:
                own = self.split(" " + c)
                words += own
                size.append(len(own))
        return heads + others, words, np.asarray(size, dtype=np.int64)

    def merge(self, word: str) -> list[int]:
        """Ids of one word, by the rank of the merges."""
        return [t.id for t in self.model.tokenize("".join(map(self.chars.__getitem__, word.encode("utf-8"))))]


@cache
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
