"""Exact subword ids of many texts: each distinct unit of text is encoded once by the tokenizers library.

A unit is a stretch that the tokenizer's own rules never look beyond, so that the ids of a text are its units' ids one
after the other. Texts in which that isn't so are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: White space that the byte-level pattern treats in runs, other than spaces and line ends; and the mark of a cut.
_OTHER = re.compile("[\x00-\x09\x0b-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters below stay letters, one each, when they are lower-cased.
_LATIN_END = "İ"
#: Units of Latin letters in lower case and printable ASCII, and the pieces that the word tokenizer cuts them into.
_LETTERS = "a-zªµºß-öø-\u012f"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+").fullmatch
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+").findall


def in_runs(text: str) -> bool:
    """Whether white space stands in other places than alone between words."""
    return any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or text[0] in " \n" or text[-1] in " \n" or _OTHER.search(text) is not None


def byte_letters() -> dict[int, int]:
    """How byte-level BPE writes bytes: those that print as themselves, the others as the characters from 256 on in turn."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class _Units(dict):
    """unit -> ids as bytes; made when first asked for. Dropped when it holds `limit` units, which bounds its memory and
    changes no result."""

    def __init__(self, tokenizer, kind: str, dtype: np.dtype, limit: int):
        self.tokenizer, self.pieces, self.kind, self.limit = tokenizer, tokenizer.model.tokenize, kind, limit
        self.letters, self.code = byte_letters(), {2: "H", 4: "I"}[dtype.itemsize]
        self.space = chr(self.letters[32])

    def __missing__(self, unit) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if self.kind == "word" and unit.isalpha():  # of ASCII letters, in lower case already, which stand for themselves
            self[unit] = out = array(self.code, [t.id for t in self.pieces(unit.decode())]).tobytes()
            return out
        text = unit.decode() if self.kind == "word" else unit
        word = text.removeprefix(" ")
        if word[-1:] in (".", ",") and word[:-1].isalpha() and (self.kind == "byte" or word[-2] < _LATIN_END or unicodedata.normalize("NFC", word).lower()[-2].isalpha()):
            # A full stop or comma after a word is a piece of its own, if what the word ends with is a letter when it is normalised too.
            out = self[unit[:-1]] + self[unit[-1:]]
            self[unit] = out
            return out
        if self.kind == "word" and not word.isalpha() and _PLAIN(lower := text.lower()):
            pieces = _PIECES(lower)
            if len(pieces) > 1:
                out = b"".join([self[x.encode()] for x in pieces])
            else:  # a piece without letters is ASCII, which stands for itself
                out = array(self.code, [t.id for t in self.pieces(text)]).tobytes()
            self[unit] = out
            return out
        if word.isalpha() and max(word) < _LATIN_END:
            # A word of Latin letters is one piece: the model alone does, on its letters as bytes.
            if self.kind == "word":
                text = unicodedata.normalize("NFC", text.lower())
            letters = text.replace(" ", self.space) if word.isascii() else text.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.pieces(letters)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[unit] = out = array(self.code, ids).tobytes()
        return out


class Encoder:
    """Ids of texts as little-endian bytes, of 2 bytes an id for a vocabulary of up to 65,536 ids, or else 4.

    kind "byte": byte-level BPE. A word takes the space before it; a unit is a word with it, or a line end.
    kind "word": BPE with word ends, in lower case, that drops white space; a unit is a word.
    A special token's string within a text becomes its id, as the library does by default.
    """

    def __init__(self, path: str, kind: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        # Units hold no special token as such: a text that does is encoded whole.
        self.tokenizer.encode_special_tokens = True
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.as_whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache = _Units(self.tokenizer, kind, self.dtype, limit)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """A null text counts as empty."""
        get, out = self.cache.__getitem__, []
        for text in texts:
            if text and any(x in text for x in self.special):
                out.append(np.array(self.as_whole().encode(text, add_special_tokens=False).ids, self.dtype).tobytes())
                continue
            if self.kind == "word":
                out.append(b"".join(map(get, (text or "").encode().lower().split())))
                continue
            if not text:
                units = []
            elif in_runs(text):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes())
                continue
            else:
                units = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
            out.append(b"".join(map(get, filter(None, units))))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Encoder:
    """A process's encoder, which keeps its units from task to task."""
    return Encoder(path, kind)
