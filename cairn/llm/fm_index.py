"""A compressed full-text index of word sequences: the Burrows-Wheeler transform in a wavelet matrix, searched backwards.

Patterns are searched in step with each other: one step extends every pattern of a batch by the word to its left, with numpy. A wavelet
matrix holds one bit for each word and level, and a count for every 64 of them.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np

_END, _GAP = 0, 1


def _bits_needed(n: int) -> int:
    return max(1, int(n - 1).bit_length())


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs before place i, for arrays of both."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels, now = [], symbols
        for level in range(_bits_needed(alphabet) - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype="i4")[:-1]]).astype("i4")
            self.levels.append((level, words, before, int(len(bit) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])
        codes = np.arange(alphabet)
        self.base = self._place(codes, np.zeros(alphabet, "i8"))

    def _place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in self.levels:
            at, off = i >> 6, (i & 63).astype("u8")
            ones = before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << off) - np.uint64(1)))
            i = np.where(c >> level & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._place(c, i) - self.base[c]


def suffix_array(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``seq``, whose last symbol is its least and occurs once, and the lengths that neighbours share (-1 before
    the first), by doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype("i8")
    ranks, step = [rank], 1
    while True:
        second = np.zeros(n, "i8")
        second[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + second
        sa = np.argsort(key, kind="stable")
        same = key[sa]
        rank = np.empty(n, "i8")
        rank[sa] = np.concatenate([[0], np.cumsum(same[1:] != same[:-1])])
        if rank[sa[-1]] == n - 1:
            break
        ranks.append(rank.astype("i4"))
        step *= 2
    a, b, shared = sa[:-1], sa[1:], np.zeros(n - 1, "i8")
    for k in range(len(ranks) - 1, -1, -1):
        at, to = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
        shared += np.where((ranks[k][at] == ranks[k][to]) & (at != to), 1 << k, 0)
    return sa, np.concatenate([[-1], shared])


class FMIndex:
    """Index of word sequences, each with the id of its document; ids are comparable and not null."""

    def __init__(self, texts: list[list[bytes]], owners: list, window: int):
        self.window, self.codes, self.owners = window, {}, sorted(set(owners))
        number, place, parts, whose = self.codes, {o: k for k, o in enumerate(self.owners)}, [], []
        for words, owner in zip(texts, owners, strict=True):
            own = np.fromiter((number.setdefault(w, len(number) + 2) for w in words), "i8", len(words))
            parts += [own, [_GAP]]
            whose.append(np.full(len(words) + 1, place[owner]))
        seq = np.concatenate([*parts, [_END]]).astype("i8")
        whose = np.concatenate([*whose, [0]])
        sa, self.lcp = suffix_array(seq)
        bwt = seq[sa - 1]
        self.n, self.alphabet = len(seq), len(number) + 2
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=self.alphabet))[:-1]])
        self.matrix = WaveletMatrix(bwt, self.alphabet)
        # places that share their first ``window`` words, and the least document among them
        first = self.lcp < window
        self.group = np.cumsum(first) - 1
        self.bounds = np.append(np.flatnonzero(first), self.n)
        self.least = np.minimum.reduceat(whose[sa], self.bounds[:-1])
        self._near = None

    def _smaller(self) -> tuple[np.ndarray, np.ndarray]:
        """The nearest places to the left and right whose shared length is smaller; worked out when first asked for."""
        if self._near is None:
            n, lcp = self.n, [*self.lcp.tolist(), -1]
            left, right, stack = [0] * (n + 1), [n] * (n + 1), []
            for k, v in enumerate(lcp):
                while stack and lcp[stack[-1]] >= v:
                    top = stack.pop()
                    if lcp[top] > v:
                        right[top] = k
                    else:  # equal: what is smaller to the right of k is so for it too, found when k's is
                        right[top] = -k
                left[k] = stack[-1] if stack else 0
                stack.append(k)
            for k in range(n, -1, -1):
                if right[k] < 0:
                    right[k] = right[-right[k]]
            self._near = np.array(left), np.array(right)
        return self._near

    def matching_statistics(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """For each text and each place where one of its windows starts: the number in ``owners`` of the least document that has it, or -1."""
        sizes = np.array([len(t) for t in texts], "i8")
        starts = np.concatenate([[0], np.cumsum(sizes)])
        get = self.codes.get
        seq = np.fromiter((get(w, -1) for w in itertools.chain.from_iterable(texts)), "i8", starts[-1])
        found = np.full(starts[-1], -1, "i8")
        lcp, window = np.append(self.lcp, -1), self.window
        live = np.flatnonzero(sizes >= window)
        begin, at = starts[live], starts[live + 1] - 1  # at: the word to add
        low, high, size = np.zeros(len(live), "i8"), np.full(len(live), self.n, "i8"), np.zeros(len(live), "i8")
        while len(at):
            c = seq[at]
            known = c >= 0
            code = np.where(known, c, 0)
            two = self.matrix.rank(np.concatenate([code, code]), np.concatenate([low, high])) + np.tile(self.before[code], 2)
            new_low, new_high = two[: len(at)], two[len(at) :]
            went = known & (new_low < new_high)
            fails = ~went & known & (size > 0)
            lost = ~went & ~fails  # the word begins no match
            if fails.any():  # the parent interval: fewer words, more places; the same word is tried again
                failed = np.flatnonzero(fails)
                left, right = self._smaller()
                a, b = lcp[low[failed]], lcp[high[failed]]
                shared, k = np.maximum(a, b), np.where(a >= b, low[failed], high[failed])
                low[failed], high[failed] = np.where(shared > 0, left[k], 0), np.where(shared > 0, right[k], self.n)
                size[failed] = np.maximum(shared, 0)
            low, high = np.where(went, new_low, np.where(lost, 0, low)), np.where(went, new_high, np.where(lost, self.n, high))
            size = np.where(lost, 0, size + went)
            full = np.flatnonzero(went & (size >= window))
            if len(full):
                g = self.group[low[full]]
                found[at[full]] = self.least[g]
                low[full], high[full], size[full] = self.bounds[g], self.bounds[g + 1], window
            at = at - ~fails
            stay = at >= begin
            if not stay.all():
                begin, at, low, high, size = begin[stay], at[stay], low[stay], high[stay], size[stay]
        return [found[a : max(a, b - window + 1)] for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def before_document(self, owner) -> int:
        """How many of ``owners`` are less than ``owner``; all where it is None."""
        return len(self.owners) if owner is None else bisect.bisect_left(self.owners, owner)
