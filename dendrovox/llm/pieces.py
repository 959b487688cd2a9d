"""Splitting text into the pieces that byte-level BPE merges separately, a batch at a time.

The split is that of ``public_tokenizers.PATTERN``: contractions; runs of letters, of numbers or of
other marks, each with one space before it; white space, the last character of which stands alone
(or leads the next run, if it is a space). Here it is done on arrays of code points, for many
documents at once. A 64-bit rolling hash finds a piece that was met before; the piece's characters are then compared, so
pieces whose hashes collide are told apart. Pieces joined give the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, WHITE, END = range(5)
#: The code points with Unicode's White_Space property.
WHITE_POINTS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters in a chunk; a longer document is a chunk of its own.
CHUNK = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    out = np.zeros(0x110000, np.uint8)
    for prop, kind in (("L", LETTER), ("N", NUMBER)):
        for m in regex.finditer(rf"\p{{{prop}}}+", every):
            out[points[m.start() : m.end()]] = kind
    out[WHITE_POINTS] = WHITE
    return out


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def prefix_hashes(code: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of first and end places that gives the rolling hashes of those spans of code points."""
    n = len(code)
    up, down = _powers(1 << max(16, int(n).bit_length()))
    value = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum(value * up[:n], out=summed[1:])
    return lambda first, end: (summed[end] - summed[first]) * down[first] + (end - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of some texts: (joined text, its code points, first and end offset of each piece, its hash, pieces before each text)."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    kind = classes()[code]
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind[stops] = END
    change = np.empty(n + 3, bool)
    change[0] = True
    change[1:n] = kind[1:] != kind[:-1]
    change[n:] = True
    change[stops] = True
    change[stops + 1] = True
    start = change.copy()
    # the last of some white space before other text stands alone, or leads that text if it is a space
    b = np.flatnonzero(change[1:n] & (kind[1:] != WHITE) & (kind[1:] != END) & (kind[:-1] == WHITE)) + 1
    start[b - 1] = True
    start[b[code[b - 1] == 0x20]] = False
    # contractions
    a = np.flatnonzero((code == 0x27) & start[:n])
    a = a[(a + 1 < n)]
    a = a[kind[a + 1] == LETTER]
    if len(a):
        one, two = code[a + 1], code[np.minimum(a + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, width in ((a[short], 2), (a[long & ~short], 3)):
            start[found + 1] = False
            start[found + width] = True
            if width == 3:
                start[found + 2] = False
    first = np.flatnonzero(start[:n])
    end = np.append(first[1:], n)
    piece = kind[first] != END
    before = np.searchsorted(first[piece], np.append(0, stops + 1))
    first, end = first[piece], end[piece]
    hashed = prefix_hashes(code)(first, end)
    return joined, code, first, end, hashed, before


class _Growing:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type, *first: int):
        self.buffer, self.size = np.array(first, kind), len(first)

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.buffer):
            self.buffer = np.concatenate([self.buffer[: self.size], np.empty(need, self.buffer.dtype)])
        self.buffer[self.size : need] = values
        self.size = need

    @property
    def all(self) -> np.ndarray:
        return self.buffer[: self.size]


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Numbers:
    """Numbers different pieces from 0 in the order in which they are met. Equal hashes count only with equal characters."""

    def __init__(self):
        self.keys, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.start, self.codes = _Growing(np.int64, 0), _Growing(np.uint32)
        #: Pieces whose hash another piece had before.
        self.odd: dict[str, int] = {}

    def __len__(self) -> int:
        return self.start.size - 1

    @classmethod
    def of(cls, pieces: list[str]) -> Numbers:
        """Numbers that know some different pieces already, in their order."""
        numbers, sizes = cls(), np.fromiter(map(len, pieces), np.int64, len(pieces))
        joined = "".join(pieces)
        code, end = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes)
        hashed = prefix_hashes(code)(end - sizes, end)
        order = np.argsort(hashed, kind="stable")
        numbers._add(code, end - sizes, sizes)
        first = np.append(True, hashed[order][1:] != hashed[order][:-1]) if len(order) else np.empty(0, bool)
        numbers.keys, numbers.slot = hashed[order][first], order[first]
        numbers.odd = {pieces[i]: i for i in order[~first].tolist()}
        return numbers

    def copy(self) -> Numbers:
        """Another of the same knowledge, which goes on by itself."""
        other = Numbers()
        other.keys, other.slot, other.odd = self.keys, self.slot, dict(self.odd)
        for name in ("start", "codes"):
            mine = getattr(self, name)
            getattr(other, name).buffer, getattr(other, name).size = mine.all.copy(), mine.size
        return other

    def _add(self, code: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        self.start.extend(self.codes.size + np.cumsum(sizes))
        self.codes.extend(code[spans(first, sizes)])

    def number(self, joined: str, code: np.ndarray, first: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each piece; which pieces are the first of their kind, in the order of their numbers)."""
        distinct, at, back = np.unique(hashed, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        known[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] == distinct[place < len(self.keys)]
        slot, new = np.empty(len(distinct), np.int64), at[~known]
        slot[known] = self.slot[place[known]]
        slot[~known] = len(self) + np.arange(len(new))
        self.keys, self.slot = np.insert(self.keys, place[~known], distinct[~known]), np.insert(self.slot, place[~known], slot[~known])
        self._add(code, first[new], end[new] - first[new])
        slot, sizes = slot[back], end - first
        held = self.start.all
        same = held[slot + 1] - held[slot] == sizes
        compared = np.where(same, sizes, 0)
        differ = code[spans(first, compared)] != self.codes.all[spans(held[slot], compared)]
        if differ.any():
            same[np.repeat(np.arange(len(same)), compared)[differ]] = False
        more = []
        for k in np.flatnonzero(~same).tolist():
            piece = joined[first[k] : end[k]]
            if piece not in self.odd:
                self.odd[piece] = len(self)
                self._add(code, first[k : k + 1], sizes[k : k + 1])
                more.append(k)
            slot[k] = self.odd[piece]
        return slot, np.append(new, more).astype(np.int64)


def one_by_one(encode: Callable[[str], list[int]]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """What ``PieceTable`` takes, from a function that encodes a piece."""

    def many(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = list(map(encode, pieces))
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return sizes, np.fromiter((i for x in made for i in x), np.uint32, int(sizes.sum()))

    return many


class PieceTable:
    """Encodes batches of texts, remembering the ids of about ``limit`` pieces at most (a bound on memory only).

    ``encode`` gets the pieces not met so far and returns the number of ids of each, and the ids.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.make, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.numbers, self.offset, self.flat = Numbers(), _Growing(np.int64, 0), _Growing(np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, ids in each piece, characters in each piece, pieces before each text)."""
        if len(self.numbers) > self.limit:
            self.clear()
        joined, code, first, end, hashed, before = split(texts)
        slot, new = self.numbers.number(joined, code, first, end, hashed)
        if len(new):
            sizes, ids = self.make([joined[first[i] : end[i]] for i in new.tolist()])
            self.offset.extend(self.flat.size + np.cumsum(sizes))
            self.flat.extend(ids)
        offset = self.offset.all
        sizes = offset[slot + 1] - offset[slot]
        return self.flat.all[spans(offset[slot], sizes)], sizes, end - first, before

    def documents(self, texts: list[str | None]) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text, null as empty: (its ids, ids in each piece, characters in each piece)."""
        for chunk in chunks(texts):
            ids, sizes, chars, before = self.encode(chunk)
            cut = np.append(0, np.cumsum(sizes))[before]
            for i in range(len(chunk)):
                yield ids[cut[i] : cut[i + 1]], sizes[before[i] : before[i + 1]], chars[before[i] : before[i + 1]]


def chunks(texts: list[str | None]) -> Iterable[list[str]]:
    """Lists of texts of about ``CHUNK`` characters, null as empty."""
    some, size = [], 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1])
        if size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


class Memo(dict):
    """``key -> make(key)``, remembering at most ``limit`` answers; a bound on memory only."""

    def __init__(self, make: Callable, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.make(key)
        return value
