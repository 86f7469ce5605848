"""Encoding of whole texts by a `tokenizers` file, each distinct unit once per worker.

Byte-level BPE never merges across a pre-token. In texts whose characters are all in STABLE
(scripts whose classes and case rules are the same in every library), a blank between two
visible characters always starts a pre-token, so the text can be cut there and the ids of a cut
depend on the cut alone: the library's model runs once for each distinct cut, and a dictionary
gives the others. Any other text goes to the library as a whole, as does one that holds the content of
an added token (such as an end mark), which the library by default takes for that token.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

#: Characters outside of this set send the whole text to the library.
UNSTABLE = re.compile("[^\x00-\x1b\x20-\x84\x86-įı-˿‐-‧€]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free code from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Known(dict):
    """What a function makes of each key, made when it is asked for first."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class UnitEncoder:
    """ids of texts as little-endian bytes of `width` bytes an id."""

    def __init__(self, path: str, words: bool, most: int = 1_500_000, ordinary: bool = False):
        """words: the vocabulary lower-cases and drops white space; else it keeps every byte. ordinary:
        contents of added tokens are ordinary text, which is not the library's default."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = ordinary
        added = {} if ordinary else self.library.get_added_tokens_decoder()
        contents = sorted(token.content for token in added.values())
        self.added = re.compile("|".join(map(re.escape, contents)), re.I) if contents else None
        self.mark = os.path.commonprefix(contents).rstrip("".join(filter(str.isalpha, "".join(contents)))) if contents else ""
        self.model = self.library.model
        self.words, self.most, self.known = words, most, Known(self._fresh)
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.letters = dict(enumerate(byte_letters()))
        self.blank, self.marks = self.letters[32], {}
        if words:
            steps = json.loads(self.library.to_str())["pre_tokenizer"]["pretokenizers"]
            self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        else:
            from public_tokenizers import PATTERN

            self.pattern = regex.compile(PATTERN)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> list[int]:
        """ids of one pre-token."""
        spelled = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.letters)
        return [token.id for token in self.model.tokenize(spelled)]

    def _cut(self, text: str) -> bytes:
        ids = array(self.code)
        for piece in self.pattern.findall(text):
            ids.extend(self._piece(piece))
        return ids.tobytes()

    def _unit(self, unit: str) -> bytes:
        """ids of a cut: by far the most are a word, or a word and one mark, whose parts need no pattern."""
        if unit.isalpha():
            if self.words:
                return array(self.code, self._piece(unit)).tobytes()
            spelled = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
            return array(self.code, [token.id for token in self.model.tokenize(self.blank + spelled)]).tobytes()
        word, mark = unit[:-1], unit[-1:]
        if mark in ",.;:!?" and word.isalpha():
            if mark not in self.marks:
                self.marks[mark] = self._cut(mark)
            return self.known[word] + self.marks[mark]
        return self._cut(unit if self.words else " " + unit)

    def _fresh(self, unit: str) -> bytes | int:
        """ids of a cut; 0 if it is empty or ends in white space, which belongs to a longer run of it: not a cut."""
        return 0 if not self.words and (not unit or unit[-1].isspace()) else self._unit(unit)

    def encode(self, text: str) -> bytes:
        if len(self.known) > self.most:
            self.known.clear()
        if not text:
            return b""
        if UNSTABLE.search(text) or self.added and self.mark in text and self.added.search(text):
            return self._whole(text)
        if self.words:
            return b"".join(map(self.known.__getitem__, text.lower().split()))
        units = text.split(" ")
        first = units.pop(0)
        if not units:
            return self._cut(first)
        if first and first[-1].isspace():
            return self._cut(text)
        try:
            return (self._cut(first) if first else b"") + b"".join(map(self.known.__getitem__, units))
        except TypeError:
            return self._cut(text)


_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, words: bool) -> UnitEncoder:
    """One encoder and its dictionary for the life of a Python worker."""
    if (path, words) not in _encoders:
        _encoders[path, words] = UnitEncoder(path, words)
    return _encoders[path, words]
