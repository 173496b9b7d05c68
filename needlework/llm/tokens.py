"""Token ids of many texts at a time, for a tokenizer that encodes its pieces one by one.

The tokenizer cuts a text into runs of letters, single digits and runs of other marks,
and encodes each piece by itself.  Here all texts of a batch are cut
at once, equal pieces are coded once, and pieces met before are looked up.  Texts whose letters need
more than lower case (rare marks, other scripts, special tokens) are left to the
tokenizer as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE, LETTER, DIGIT, OTHER, TWO, THREE, RARE = range(7)
#: What may follow an apostrophe to form a piece with it.
SUFFIXES = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of a character by its first byte, and of one of two bytes (U+0080 to U+017F) by its number."""

    def kind(c: str) -> int:
        if c.isspace():
            return SPACE if c < "\x7f" else RARE
        of = unicodedata.category(c)[0]
        return LETTER if of == "L" else DIGIT if of == "N" else OTHER

    first = np.full(256, RARE, dtype=np.uint8)
    first[:128] = [kind(chr(c)) if not 28 <= c < 32 else OTHER for c in range(128)]
    first[0xC2:0xC6], first[0xE2] = TWO, THREE
    second = np.array([kind(chr(c)) for c in range(0x80, 0x180)], dtype=np.uint8)
    second[0x130 - 0x80] = RARE  # its small letter is two characters
    return first, second


FIRST, SECOND = byte_kinds()
SMALL = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], dtype=np.uint8)


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All pieces of the texts in order, with A-Z lower-cased, how many each text has, and texts that are not cut.

    A piece is a run of letters, a digit, a run of other marks, or an apostrophe with one
    of ``SUFFIXES``.  Texts are cut if all their characters are Latin letters, common
    punctuation or ASCII; others, and those that may hold a special token, are named only.
    """
    data = SMALL[np.frombuffer(b" ".join([*texts, b"   "]), dtype=np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    kind = FIRST[data]
    two = np.flatnonzero(kind == TWO)
    number = (data[two].astype(np.int64) - 0xC2) * 64 + (data[two + 1] & 63)
    kind[two] = kind[two + 1] = np.where(data[two + 1] >> 6 == 2, SECOND[number], RARE)
    three = np.flatnonzero(kind == THREE)
    b, c = data[three + 1], data[three + 2]
    common = ((b == 0x80) & (c >= 0x90) & (c <= 0xA7)) | ((b == 0x82) & (c == 0xAC))
    kind[three] = kind[three + 1] = kind[three + 2] = np.where(common, OTHER, RARE)
    odd = np.concatenate([np.flatnonzero(kind >= TWO), np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))])
    rare = np.unique(np.searchsorted(ends, odd, side="right"))
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | ((kind[1:] == DIGIT) & (data[1:] >> 6 != 2))
    quote = np.flatnonzero(data == 39)
    quote = quote[(quote == 0) | (kind[quote - 1] != OTHER)]
    for suffix in SUFFIXES:
        at = quote
        for k, letter in enumerate(suffix, 1):
            at = at[data[at + k] == letter]
        start[at + 1] = False
        start[at + 1 + len(suffix)] = kind[at + 1 + len(suffix)] != SPACE
    kept = kind != SPACE
    for t in rare.tolist():
        start[ends[t] - 1 - len(texts[t]) : ends[t]] = kept[ends[t] - 1 - len(texts[t]) : ends[t]] = False
    first = np.flatnonzero(start)
    place = np.cumsum(kept) - kept
    offsets = np.append(place[first], kept.sum()).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
    return pieces, np.diff(np.searchsorted(first, ends), prepend=0), rare


class TextIds:
    """Ids of texts; at most about ``most`` bytes of known pieces are kept, and those of the last batch."""

    #: What a known piece takes beside its own bytes.
    OVERHEAD = 150

    def __init__(self, tokenizer_file: str, most: int = 48 << 20, longest: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(tokenizer_file), most, longest
        size = self.tokenizer.get_vocab_size() + 1
        self.sentence_ends, self.piece_ends = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.piece_ends[at] = token.endswith("</w>")
            self.sentence_ends[at] = re.search(r"[.!?][\"')\]]*</w>$", token) is not None
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.kept = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, encoded together, and how many each has: the last id of a piece says that it ends."""
        ids = self.whole(" ".join(pieces))
        ends = np.flatnonzero(self.piece_ends[ids]) + 1
        if len(ends) != len(pieces):
            each = [self.whole(p) for p in pieces]
            return np.concatenate(each), np.array([len(e) for e in each])
        return ids, np.diff(ends, prepend=0)

    def add(self, pieces: list[bytes]) -> None:
        first, at = len(self.known), len(self.pool)
        lots = [self.coded([p.decode() for p in pieces[lo : lo + 4096]]) for lo in range(0, len(pieces), 4096)]
        sizes = np.concatenate([n for _, n in lots])
        self.known.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in lots)])
        self.start = np.concatenate([self.start, at + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.kept += sum(map(len, pieces)) + self.OVERHEAD * len(pieces)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces in ``start`` and ``length``; unknown ones are added."""
        if self.kept > self.most:
            numbers = [(p, self.known[p]) for p in pieces if p in self.known]
            start, length, pool = self.start, self.length, self.pool
            self.forget()
            at = np.array([n for _, n in numbers], dtype=np.int64)
            self.known = {p: k for k, (p, _) in enumerate(numbers)}
            self.length = length[at]
            self.pool = pool[ranges(start[at], self.length)]
            self.start = np.cumsum(self.length) - self.length
            self.kept = sum(map(len, self.known)) + self.OVERHEAD * len(self.known)
        if new := [p for p in pieces if p not in self.known]:
            self.add(new)
        return np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text."""
        if not texts:
            return []
        pieces, many, rare = cut(texts)
        size = np.diff(np.frombuffer(pieces.buffers()[1], dtype=np.int64))
        long = np.flatnonzero(size > self.longest)
        if len(long):  # not to be kept
            short = np.flatnonzero(size <= self.longest)
            found = [self.whole(p.decode()) for p in pieces.take(pa.array(long)).to_pylist()]
            own, lengths = self.looked_up(pieces.take(pa.array(short)))
            length = np.zeros(len(size), dtype=np.int64)
            length[short], length[long] = lengths, [len(f) for f in found]
            begin = np.cumsum(length) - length
            ids = np.empty(length.sum(), dtype=np.uint32)
            ids[ranges(begin[short], lengths)] = own
            ids[ranges(begin[long], length[long])] = np.concatenate(found)
        else:
            ids, length = self.looked_up(pieces)
        until = np.append(0, np.cumsum(length))[np.cumsum(many)].tolist()
        parts = [ids[a:b] for a, b in zip([0, *until[:-1]], until, strict=True)]
        for t in rare.tolist():
            parts[t] = self.whole(texts[t].decode("utf-8", "replace"))
        return parts

    def looked_up(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has."""
        coded = flat.dictionary_encode()
        number = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        lengths = self.length[number]
        return self.pool[ranges(self.start[number], lengths)], lengths


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after another."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(length.sum())


@lru_cache(maxsize=1)
def text_ids(tokenizer_file: str) -> TextIds:
    """One for all tasks of a Python worker that need it at the same time."""
    return TextIds(tokenizer_file)
