"""Two-stage suffix sorting of many short strings, and common prefixes of neighbours.

A suffix that is smaller than its successor (the suffix one byte on) is sorted
directly, by words of seven bytes. All others follow from them: scanned bucket by
bucket in order of first byte, every sorted suffix puts the one before it, if that
one is larger than its successor, next in the bucket of its first byte. The scan
takes a bucket in waves: what earlier buckets put there, then what these put into
their own bucket, and so on, then the directly sorted ones. If only some suffixes are
wanted, only these are put in order and those that they follow from: of each
wanted suffix its successors up to the next one that is sorted directly.
"""

from __future__ import annotations

import numpy as np

WORD = 7  # bytes of a word; the eighth byte counts those before the string's end
U64 = np.uint64


# masks of the first bytes of a word, by their number
_HEAD = np.array([(1 << 64) - (1 << 8 * (8 - k)) for k in range(WORD + 1)], U64)


class Suffixes:
    """Strings laid end to end, a separator below every byte after each."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1            # of each string, its separator
        self.starts = self.ends - sizes
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        self.codes = raw.astype(np.int16) + 1
        self.codes[self.ends] = 0
        room = np.repeat(self.ends, sizes + 1) - np.arange(len(raw))
        padded = np.concatenate([raw, np.zeros(WORD, np.uint8)])
        self.words = np.ndarray(len(raw), ">u8", padded, strides=(1,)).astype(U64)  # the eight bytes from each place on
        room = np.minimum(room, WORD)
        self.words &= _HEAD[room]
        self.words |= room.astype(U64)

    def larger(self) -> np.ndarray:
        """Which suffixes are larger than their successor."""
        n = len(self.codes)
        step = np.zeros(n, np.int16)
        step[:-1] = self.codes[1:] - self.codes[:-1]
        decided = np.where(step != 0, np.arange(n), n - 1)
        return step[np.minimum.accumulate(decided[::-1])[::-1]] < 0

    def sort_directly(self, suffixes: np.ndarray, at_most: int | None = None) -> np.ndarray:
        """The given suffixes (ascending positions) in order of their first ``at_most``
        bytes or more, else of all; equal ones by position."""
        key = self.words[suffixes]
        order = np.argsort(key, kind="stable")
        out, key = suffixes[order], key[order]
        group = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(key) else key.astype(np.int64)
        open_ = np.arange(len(out))
        depth = 0
        while at_most is None or depth + WORD < at_most:
            # go on with suffixes that are equal to a neighbour and have not ended
            same = np.append(False, group[1:] == group[:-1]) if len(group) else np.zeros(0, bool)
            tied = (same | np.append(same[1:], False)) & ((key & U64(255)) == WORD)
            open_, group = open_[tied], group[tied]
            if not len(open_):
                break
            depth += WORD
            key = self.words[out[open_] + depth]
            apart = (group[1:] == group[:-1]) & (key[1:] != key[:-1])
            if apart.any():  # the other groups stay as they are
                mixed = np.zeros(group[-1] + 1, bool)
                mixed[group[1:][apart]] = True
                part = np.flatnonzero(mixed[group])
                order = part[np.lexsort((key[part], group[part]))]
                out[open_[part]], key[part] = out[open_[order]], key[order]
                group = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        return out

    def order(self, wanted: np.ndarray | None = None, at_most: int | None = None) -> np.ndarray:
        """All suffixes in order, or the wanted ones (flags) by their first ``at_most`` bytes or more."""
        codes, larger = self.codes, self.larger()
        needed = np.ones(len(codes), bool) if wanted is None else self.sources(wanted, larger)
        direct = self.sort_directly(np.flatnonzero(~larger & needed), at_most)
        larger &= needed
        first = codes[direct]
        put: dict[int, list[np.ndarray]] = {}
        out = []

        def induce(sorted_: np.ndarray, own: int) -> np.ndarray:
            """Put the predecessors into their buckets; those of the bucket itself come back."""
            before = sorted_[sorted_ > 0] - 1
            before = before[larger[before]]
            bucket = codes[before]
            mine = bucket == own
            rest, bucket = before[~mine], bucket[~mine]
            if len(rest):
                by = np.argsort(bucket, kind="stable")
                rest, bucket = rest[by], bucket[by]
                cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
                for part, c in zip(np.split(rest, cuts), bucket[np.append(0, cuts)].tolist()):
                    put.setdefault(c, []).append(part)
            return before[mine]

        for c in np.unique(codes).tolist():
            wave = np.concatenate(put.pop(c)) if c in put else np.zeros(0, np.int64)
            while len(wave):
                out.append(wave)
                wave = induce(wave, c)
            a, b = np.searchsorted(first, [c, c + 1])
            out.append(direct[a:b])
            induce(direct[a:b], c)
        found = np.concatenate(out) if out else np.zeros(0, np.int64)
        return found if wanted is None else found[wanted[found]]

    @staticmethod
    def sources(wanted: np.ndarray, larger: np.ndarray) -> np.ndarray:
        """The wanted suffixes and their successors up to the next one that is not larger than its own."""
        n = len(larger)
        ahead = np.minimum.accumulate(np.where(larger, n - 1, np.arange(n))[::-1])[::-1]
        turns = np.zeros(n + 1, np.int64)
        turns[:n] = wanted
        turns[1:] -= np.bincount(ahead[wanted], minlength=n)
        return np.cumsum(turns[:n]) > 0

    def common_prefixes(self, order: np.ndarray, at_most: int) -> np.ndarray:
        """Bytes that each suffix of ``order`` shares with the one before, counted up to ``at_most``."""
        shared = np.zeros(len(order), np.int64)
        pair, depth = np.arange(1, len(order)), 0
        while len(pair) and depth < at_most:
            x, y = self.words[order[pair - 1] + depth], self.words[order[pair] + depth]
            whole = (x == y) & ((x & U64(255)) == WORD)
            apart, least = (x ^ y)[~whole], np.minimum(x & U64(255), y & U64(255))[~whole].astype(np.int64)
            equal = sum(((apart >> U64(8 * (WORD - j))) == 0).astype(np.int64) for j in range(WORD))
            shared[pair[~whole]] = depth + np.minimum(equal, least)
            pair, depth = pair[whole], depth + WORD
        shared[pair] = depth
        return np.minimum(shared, at_most)

    def agree(self, order: np.ndarray, length: int) -> np.ndarray:
        """Which suffixes of ``order`` share their first ``length`` bytes with the one
        before; each has that many."""
        if length < WORD:
            return self.common_prefixes(order, length) >= length
        pair = np.arange(1, len(order))
        x, y = order[:-1], order[1:]
        for depth in [*range(0, length - WORD, WORD), length - WORD]:
            same = self.words[x + depth] == self.words[y + depth]
            if not same.all():
                pair, x, y = pair[same], x[same], y[same]
        agree = np.zeros(len(order), bool)
        agree[pair] = True
        return agree


def repeated_starts(strings: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """Per string, which of its first ``starts`` positions begin ``length`` bytes
    that begin at another of these positions too."""
    if not strings:
        return []
    s = Suffixes(strings)
    place = np.concatenate([np.arange(a, a + n) for a, n in zip(s.starts.tolist(), starts)])
    wanted = np.zeros(len(s.codes), bool)
    wanted[place] = True
    order = s.order(wanted, length)
    close = s.agree(order, length)
    found = np.zeros(len(s.codes), bool)
    found[order[close | np.append(close[1:], False)]] = True
    return np.split(found[place], np.cumsum(starts)[:-1])
