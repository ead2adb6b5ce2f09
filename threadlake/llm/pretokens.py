"""Pre-tokenisation of many texts at once, by character classes of their UTF-8 bytes, and numbers for distinct tokens.

The pattern that splits texts for byte-level vocabularies is told by runs of letters, digits, white space and other
characters: one blank goes with the run behind it, a longer white-space run keeps all but its last character, and an
apostrophe with a short ending is a token of its own. Here the starts of all tokens follow from the classes of
characters by array operations; another pattern is applied as it is.
"""

from __future__ import annotations

import numpy as np
import regex

from threadlake.llm import kernel

#: The pattern that the arrays stand for: fixed text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4
_tables: dict[str, np.ndarray] = {}


def character_classes() -> np.ndarray:
    """The class of every code point."""
    if "classes" not in _tables:
        every = "".join(map(chr, range(0x110000)))
        t = np.full(0x110000, OTHER, np.uint8)
        for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
            for m in regex.finditer(pattern, every):
                t[m.start() : m.end()] = k
        _tables["classes"] = t
    return _tables["classes"]


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = character_classes()
    c = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        d = np.concatenate([data, np.zeros(3, np.uint8)])
        own = table[kernel.code_points(d, lead)]
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        c = np.concatenate([c, np.zeros(3, np.uint8)])
        for k in range(4):
            more = size > k
            c[lead[more] + k] = own[more]
        c = c[: len(data)]
    return c


def token_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions at which tokens start in texts joined end to end; bounds are the texts' ends, from 0. Tokens end where the next or the text's end is."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    c = classes(data)
    begin = np.zeros(n + 1, bool)
    begin[bounds] = True
    begin = begin[:n]
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(c[1:], c[:-1], out=run[1:])
    run |= begin
    behind_blank = np.zeros(n, bool)
    behind_blank[1:] = data[:-1] == 32
    behind_blank &= ~begin
    start = run & ~(behind_blank & (c != BLANK))
    # the last character of a white-space run begins a token; it may have several bytes
    last = np.flatnonzero((c[:-1] == BLANK) & run[1:] & ~begin[1:])
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    at = np.flatnonzero((data == 39) & start)
    if len(at):
        letter = lambda i: np.where((i < n) & ~begin[np.minimum(i, n - 1)] & (c[np.minimum(i, n - 1)] == LETTER), data[np.minimum(i, n - 1)], 0)
        a = letter(at + 1)
        b = np.where(a > 0, letter(at + 2), 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        hit = one | two
        start[at[hit] + 1] = False
        end = at[hit] + np.where(one[hit], 2, 3)
        start[end[(letter(end) > 0)]] = True
    return np.flatnonzero(start)


def token_bounds(data: np.ndarray, bounds: np.ndarray, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of UTF-8 texts that lie end to end within bounds, and the range of tokens of each text."""
    if pattern == PATTERN:
        starts = token_starts(data, bounds)
    else:
        found = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            words = [m[0].encode() for m in regex.finditer(pattern, data[a:b].tobytes().decode())]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            if sizes.sum() != b - a:
                raise ValueError("the pattern must take every character of a text")
            found.append(a + np.cumsum(sizes) - sizes)
        starts = np.concatenate(found) if found else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(data)) if len(starts) else starts, np.searchsorted(starts, bounds)


class Vocabulary:
    """Numbers from 0 for distinct byte strings in the order in which they are met, looked up by arrays.

    Strings are told apart by 128 bits of hashes: 64 find the place in an open-addressed table, 64 more are compared there.
    Of strings that agree in the first half only, the later ones are kept in a dictionary. The table grows as it fills.
    """

    def __init__(self, bits: int = 16):
        self.n = 0
        self.odd: dict[bytes, int] = {}
        self.second = np.zeros(1 << bits - 1, np.uint64)
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.bits, self.shift, self.mask = bits, np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.places = np.full(1 << bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        at = (hashes >> self.shift).astype(np.int64)
        out = self.places[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            got = self.places[at]
            hit = (got < 0) | (self.keys[at] == hashes[left])
            out[left[hit]] = got[hit]
            left, at = left[~hit], at[~hit]
        return out

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        left = np.arange(len(hashes))
        at = (hashes >> self.shift).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.places[at] < 0)
            # of several that want a place the last written one has it
            self.places[at[free]] = numbers[left[free]]
            self.keys[at[free]] = hashes[left[free]]
            lost = self.places[at] != numbers[left]
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _add(self, hashes: np.ndarray, second: np.ndarray) -> None:
        """Give the next numbers to hashes that are not there, all different. The table stays half empty."""
        total = self.n + len(hashes)
        if 2 * total > len(self.keys):
            used = np.flatnonzero(self.places >= 0)
            keys, numbers = self.keys[used], self.places[used]
            self._empty((2 * total).bit_length())
            self._put(keys, numbers)
        if total > len(self.second):
            self.second = np.concatenate([self.second, np.zeros(max(len(self.second), total - len(self.second)), np.uint64)])
        self.second[self.n : total] = second
        self._put(hashes, np.arange(self.n, total, dtype=np.int32))
        self.n = total

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The number of each range of data, and the strings that are new, in the order of their numbers."""
        return self.place(*kernel.byte_hashes(data, starts, ends, two=True), data, starts, ends)

    def place(self, first: np.ndarray, second: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        out = self.find(first)
        new: list[bytes] = []
        miss = np.flatnonzero(out < 0)
        if len(miss):
            distinct, at, inverse = np.unique(first[miss], return_index=True, return_inverse=True)
            order = np.argsort(at)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            own = miss[at[order]]
            out[miss] = self.n + rank[inverse]
            self._add(distinct[order], second[own])
            new = [data[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
        for i in np.flatnonzero(self.second[out] != second).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in self.odd:
                self.odd[word] = self.n
                new.append(word)
                self._skip()
            out[i] = self.odd[word]
        return out, new

    def _skip(self) -> None:
        """Use up a number that no hash in the table has."""
        if self.n == len(self.second):
            self.second = np.concatenate([self.second, np.zeros(len(self.second), np.uint64)])
        self.n += 1
