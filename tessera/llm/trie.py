"""An n-gram trie whose levels and pointers are Elias-Fano sequences, in one flat buffer that is read in place."""

from __future__ import annotations

import mmap

import numpy as np

_AT_ONCE = 1 << 16


class Monotone:
    """An Elias-Fano sequence of n non-decreasing numbers: of each, the low bits packed side by side, and the rest in unary.

    When the sequence is mapped, the high parts and where each begins are read from the unary bits into a directory; the low bits stay as they are.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.mask = n, bits, np.uint64((1 << bits) - 1)
        self.words = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,))  # a word at each byte
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))[:n]
        part = ones - np.arange(n)
        self.part = part.astype(np.int32) if n and part[-1] < 1 << 31 else part
        self.first = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1))])

    @staticmethod
    def build(v: np.ndarray) -> list[np.ndarray]:
        """Sizes, packed low bits (with room for a word at the last byte) and unary high parts."""
        v = np.asarray(v, np.uint64)
        n = len(v)
        bits = min(56, max(0, (int(v[-1]) // n).bit_length() - 1)) if n else 0
        low = v & np.uint64((1 << bits) - 1)
        if bits:
            place = np.arange(bits, dtype=np.uint64)
            parts = [np.packbits(((low[i : i + _AT_ONCE, None] >> place) & np.uint64(1)).astype(np.uint8), bitorder="little") for i in range(0, n, _AT_ONCE)]
        else:
            parts = []
        high = np.zeros(int(v[-1] >> np.uint64(bits)) + n if n else 0, np.uint8)
        if n:
            high[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return [np.array([n, bits], "<i8").view(np.uint8), np.concatenate([*parts, np.zeros(8, np.uint8)]), np.packbits(high, bitorder="little")]

    def low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        return (self.words[at >> 3] >> (at & 7).astype(np.uint64)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        return (self.part[i].astype(np.int64) << self.bits) | self.low(i).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that is x or more, n if there is none; and whether it is x: the numbers that share x's high part
        are a short run, which is halved until the place is found."""
        part = np.minimum(x >> self.bits, len(self.first) - 1)
        left, right = self.first[part], self.first[np.minimum(part + 1, len(self.first) - 1)]
        end, low = right, x.astype(np.uint64) & self.mask
        left = left.copy()
        right = right.copy()
        live = np.flatnonzero(left < right)
        while len(live):
            mid = (left[live] + right[live]) >> 1
            less = self.low(mid) < low[live]
            left[live[less]] = mid[less] + 1
            right[live[~less]] = mid[~less]
            live = live[left[live] < right[live]]
        same = left < end
        same[same] = self.low(left[same]) == low[same]
        return left, same


#: Logarithms are rounded to a STEP-th of a decade; a code is 16 bits, and 0 means no value.
STEP = 2048


def coded(v: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(v > 0, np.clip(np.rint(-np.log10(v) * STEP) + 1, 1, 65535), 0).astype("<u2")


def decoded(c: np.ndarray, none: float) -> np.ndarray:
    return np.where(c > 0, 10.0 ** ((1.0 - c) / STEP), none)


class Trie:
    """Levels 1 to order of n-grams. Level 1 is the sorted ids of first words. Level k > 1 lists for each node of the level before its next words:
    begin[k] points to where a node's list begins, and the lists are one rising sequence, in which each word is added to the last number of the
    list before. prob[k] has the nodes' coded probabilities, back[k] what they leave to shorter contexts."""

    def __init__(self, data, order: int):
        """Maps the buffer that build() gives; nothing but the sequences' directories is copied."""
        raw = np.frombuffer(data, np.uint8)
        sizes = raw[: 8 * int(raw[:8].view("<i8")[0])].view("<i8")[1:]
        at, parts = 8 * (len(sizes) + 1), []
        for s in sizes.tolist():
            parts.append(raw[at : at + s])
            at += s

        def sequence():
            head, low, high = (parts.pop(0) for _ in range(3))
            return Monotone(*head.view("<i8").tolist(), low, high)

        self.words, self.begin, self.prob, self.back = {1: sequence()}, {}, {}, {}
        for k in range(2, order + 1):
            self.begin[k], self.words[k] = sequence(), sequence()
            self.prob[k], self.back[k] = parts.pop(0).view("<u2"), parts.pop(0).view("<u2")

    @staticmethod
    def build(first: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> mmap.mmap:
        """first: sorted ids. levels: of each level from 2 up, by parent, then by word: parent's place, word, coded probability, coded back-off."""
        out, n = Monotone.build(first), len(first)
        for parent, word, prob, back in levels:
            begin = np.searchsorted(parent, np.arange(n + 1))
            last = np.zeros(n, np.int64)
            some = begin[1:] > begin[:-1]
            last[some] = word[begin[1:][some] - 1]
            base = np.cumsum(last) - last
            out += [*Monotone.build(begin), *Monotone.build(base[parent] + word if len(word) else word), np.asarray(prob, "<u2").view(np.uint8), np.asarray(back, "<u2").view(np.uint8)]
            n = len(word)
        head = np.array([len(out) + 1, *map(len, out)], "<i8").view(np.uint8)
        data = mmap.mmap(-1, len(head) + sum(map(len, out)))
        for x in (head, *out):
            data.write(x.tobytes())
        return data

    def firsts(self, ids: np.ndarray) -> np.ndarray:
        """Places of first words, -1 where there is none."""
        at, same = self.words[1].successor(ids)
        return np.where(same, at, -1)

    def children(self, k: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places in level k of the words that follow nodes of level k - 1, -1 where there is none or no parent: the successor of the word within
        the parent's list."""
        out = np.full(len(parent), -1)
        some = np.flatnonzero((parent >= 0) & (word > 0))
        begin, words = self.begin[k], self.words[k]
        if not len(some) or not words.n:
            return out
        a, b = begin.get(parent[some]), begin.get(parent[some] + 1)
        base = np.where(a > 0, words.get(np.maximum(a - 1, 0)), 0)
        at, same = words.successor(base + word[some])
        ok = same & (at >= a) & (at < b)
        out[some[ok]] = at[ok]
        return out
