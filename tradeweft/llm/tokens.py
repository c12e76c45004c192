"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

Both tokenizers used here cut a text at white space before they merge, so the ids of a text are
those of its words one after the other. A word of Latin characters goes through the library's
merge model by the pieces of the tokenizer's own pattern; any other word, and any text with
unusual white space, goes through the whole tokenizer. The words of many texts are made distinct by
numpy, by hash and then by their bytes; only distinct ones are looked up and encoded where new.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from tradeweft.llm.hashing import cut_words, distinct

#: Bytes that one Python worker remembers of words and of word pieces, each; then they start anew.
HELD = 128 << 20
#: Bytes of text whose words are made distinct together.
GROUP = 4 << 20
#: White space of Unicode, as the tokenizers' patterns see it.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = regex.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
_ODD_SPACE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The pattern of byte-level tokenizers that name none (public, of the first such tokenizer).
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Known(dict):
    """Word or word piece -> its ids as little-endian 32-bit integers, of at most ``most`` bytes.

    When half of that is full, what was not asked for since the last time is forgotten.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.held, self.before = make, most, 0, {}

    def __missing__(self, key) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.make(key)
        size = len(key) + len(ids) + 200  # two objects and a slot
        self.held += size
        if self.held > self.most // 2:
            self.before = self.copy()
            self.clear()
            self.held = size
        self[key] = ids
        return ids


class Encoder:
    def __init__(self, path: str, held: int | None = None, group: int = GROUP):
        held = HELD if held is None else held
        self.group = group
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        normalizer = form["normalizer"] or {"normalizers": []}
        self.lower = any(n["type"] == "Lowercase" for n in normalizer["normalizers"])
        steps = form["pre_tokenizer"].get("pretokenizers", [])
        own = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.drops_space = bool(own)
        self.pattern = regex.compile(own[0] if own else _BYTE_LEVEL)
        self.letters = dict(enumerate(byte_letters()))
        self.lead = "" if self.drops_space else " "
        self.breaks = np.zeros(256, bool)
        self.breaks[[32, 10] if self.drops_space else [32]] = True
        self.pieces = _Known(self._piece, held)
        self.words = _Known(self._made, held)

    def _piece(self, piece: str) -> bytes:
        # ASCII letters stand for themselves
        text = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _made(self, word: bytes) -> bytes:
        if word[:1] != b" ":
            return self._word(word.decode())
        core = word[1:].rstrip(b".,!")
        if core.isalpha():  # of bytes: ASCII letters only
            piece = self.pieces[self.lead + (core.lower() if self.lower else core).decode()]
            return piece if len(core) == len(word) - 1 else piece + self.pieces[word[1 + len(core):].decode()]
        return self._led(word[1:].decode())

    def _led(self, word: str) -> bytes:
        """A word with the space before it, where the tokenizer keeps that."""
        core = word.rstrip(".,!")
        low = core.lower() if self.lower else core
        if low.isalpha() and max(low) < "\u0250":
            piece = self.pieces[self.lead + low]
            return piece if len(core) == len(word) else piece + self.pieces[word[len(core):]]
        return self._word(self.lead + word)

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if max(word) < "\u0250":
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word.lower() if self.lower else word)))
        return self._all(word)

    def _all(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers; none for null."""
        out: list[bytes] = []
        for group in units(texts, self.breaks, not self.drops_space, self.group):
            out += group.laid_out(list(map(self.words.__getitem__, group.words())))
        return out


class Group:
    """The distinct words of some texts, and each text as a run of numbers of them."""

    def __init__(self, data: list[bytes], breaks: np.ndarray, spaced: bool):
        self.raw, self.starts, self.ends, hashes, self.bounds = cut_words(data, breaks, _SAME)
        self.first = np.zeros(len(hashes), bool)
        if spaced:  # the first word of a text has no space before it
            self.first[self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]] = True
            hashes = hashes ^ (self.first * np.uint64(0xA5A5A5A5A5A5A5A5))
        self.at, self.inverse = distinct(self.raw, self.starts, self.ends, hashes)

    def words(self) -> list[bytes]:
        """The distinct words, with the space that stands before all but the first of a text."""
        buffer, alone = self.raw.tobytes(), self.first[self.at].tolist()
        return [buffer[a:b] if f else b" " + buffer[a:b]
                for a, b, f in zip(self.starts[self.at].tolist(), self.ends[self.at].tolist(), alone)]

    def laid_out(self, made: list[bytes]) -> list[bytes]:
        """For each text what was made of its words (32-bit integers), one after the other."""
        if not made:
            return [b""] * (len(self.bounds) - 1)
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat, begins = np.frombuffer(b"".join(made), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[self.inverse]
        stops = np.cumsum(counts)
        ids = flat[np.repeat(begins[self.inverse] - stops + counts, counts) + np.arange(stops[-1])]
        cuts = np.concatenate([[0], stops])[self.bounds]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


class OddText:
    """A text with unusual white space, cut by the units' pattern; same methods as a group."""

    def __init__(self, text: str):
        self.parts = _UNIT.findall(text)

    def words(self) -> list[bytes]:
        return [part.encode() for part in self.parts]

    @staticmethod
    def laid_out(made: list[bytes]) -> list[bytes]:
        return [b"".join(made)]


def units(texts: list[str | None], breaks: np.ndarray, spaced: bool, size: int = GROUP):
    """Groups of about ``size`` characters, in the order of the texts.

    ``spaced``: words keep the one space before them. Texts where white space is not single spaces
    and line feeds are then groups of their own.
    """
    data: list[bytes] = []
    total = 0
    for t in texts:
        t = t or ""
        odd = spaced and bool("  " in t or "\n " in t or " \n" in t or t[-1:] == " " or t[:1] == " " or _ODD_SPACE.search(t))
        if data and (odd or total + len(t) > size):
            yield Group(data, breaks, spaced)
            data, total = [], 0
        if odd:
            yield OddText(t)
        else:
            data.append(t.encode())
            total += len(data[-1])
    if data:
        yield Group(data, breaks, spaced)


_SAME = np.arange(256, dtype=np.uint8)


@lru_cache(maxsize=2)
def encoder(path: str, held: int | None = None, group: int = GROUP) -> Encoder:
    """One encoder per worker and vocabulary file, which has to lie at ``path`` on every node.

    ``held`` bounds the bytes it remembers of words and of pieces, ``group`` the text whose words are made
    distinct together. Both trade memory for time; the ids are the same.
    """
    return Encoder(path, held, group)
