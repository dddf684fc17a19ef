"""Suffix arrays by induced sorting (Nong, Zhang and Chan 2009) and permuted common prefixes (Karkkainen, Manzini and Puglisi 2009).

The scans of induced sorting go bucket by bucket: all suffixes of a bucket induce their left neighbours at once, in order.
"""

from __future__ import annotations

import numpy as np

#: Names of a reduced string up to which it is sorted by induced sorting again. Above, a bucket holds too few suffixes for array operations
#: and the names are refined by doubling their length.
NAMES = 512


def types(s: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next one (S type); the last, a sentinel, is."""
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    after = np.minimum.accumulate(at[::-1])[::-1] if len(at) else at
    small = np.append(step, 1)[after] > 0 if len(at) else np.zeros(0, bool)
    return np.append(small, True)


class _Buckets:
    def __init__(self, s: np.ndarray, small: np.ndarray) -> None:
        self.s, self.small = s, small
        self.counts = np.bincount(s)
        self.ends = np.cumsum(self.counts)
        self.heads = self.ends - self.counts
        self.letters = np.flatnonzero(self.counts).tolist()
        self.narrow = np.uint8 if len(self.counts) <= 256 else np.uint16 if len(self.counts) <= 65536 else np.int64

    def _deal(self, found: np.ndarray, place: np.ndarray, sign: int, out: np.ndarray) -> None:
        """Puts suffixes into their buckets in the order given, onwards from ``place`` or backwards."""
        letters = self.s[found].astype(self.narrow)
        order = np.argsort(letters, kind="stable")
        letters, found = letters[order], found[order]
        first = np.flatnonzero(np.append(True, letters[1:] != letters[:-1]))
        sizes = np.diff(np.append(first, len(letters)))
        own = letters[first].astype(np.int64)
        nth = np.arange(len(letters)) - np.repeat(first, sizes)
        start = np.repeat(place[own], sizes)
        out[start + nth if sign > 0 else start - 1 - nth] = found
        place[own] += sign * sizes

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes sorted from their leftmost smaller ones in order (or, sorted by first letters, from these in any order)."""
        s, small, n = self.s, self.small, len(self.s)
        out = np.full(n, -1, np.int64)
        seeds = np.bincount(s[lms], minlength=len(self.counts))
        order = np.argsort(s[lms].astype(self.narrow), kind="stable")
        seed, seed_ends = lms[order], np.cumsum(seeds)
        place = self.heads.copy()
        for c in self.letters:
            low = int(self.heads[c])
            while low < place[c]:
                now, low = out[low:place[c]], int(place[c])
                left = now[now > 0] - 1
                left = left[~small[left]]
                if len(left):
                    self._deal(left, place, 1, out)
            left = seed[seed_ends[c] - seeds[c]:seed_ends[c]]
            left = left[left > 0] - 1
            if len(left):
                self._deal(left, place, 1, out)
        larger = place
        place = self.ends.copy()
        out[0] = n - 1
        place[s[n - 1]] = 0
        for c in reversed(self.letters):
            high = int(self.ends[c])
            while high > place[c]:
                now, high = out[place[c]:high][::-1], int(place[c])
                left = now[now > 0] - 1
                left = left[small[left]]
                if len(left):
                    self._deal(left, place, -1, out)
            now = out[self.heads[c]:larger[c]][::-1] if c != s[n - 1] else out[:0]
            left = now[now > 0] - 1
            left = left[small[left]]
            if len(left):
                self._deal(left, place, -1, out)
        return out


def _names(s: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of leftmost smaller substrings, ``order`` being sorted by them: equal substrings have equal names."""
    n = len(s)
    size = np.zeros(n, np.int64)
    size[lms[:-1]] = np.diff(lms)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero((size[a] == size[b]) & (size[a] > 0))
    offset, equal = 0, np.zeros(len(a), bool)
    while len(same):
        same = same[s[a[same] + offset] == s[b[same] + offset]]
        done = size[a[same]] == offset
        equal[same[done]] = True
        same = same[~done]
        offset += 1
    return np.concatenate(([0], np.cumsum(~equal)))


def _doubled(names: np.ndarray) -> np.ndarray:
    """The sorted order of all suffixes of a string of names, refined by doubling; only suffixes that still tie are sorted."""
    n = len(names)
    counts = np.bincount(names)
    starts = np.cumsum(counts) - counts
    rank = starts[names]
    tied = np.flatnonzero(counts[names] > 1)
    step = 1
    while len(tied):
        after = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        key = rank[tied] * np.int64(n + 1) + after
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        group = rank[tied]
        fresh = np.append(True, key[1:] != key[:-1])
        base = np.append(True, group[1:] != group[:-1])
        index = np.arange(len(tied))
        first, ground = np.maximum.accumulate(np.where(fresh, index, 0)), np.maximum.accumulate(np.where(base, index, 0))
        rank[tied] = group + first - ground
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The sorted order of all suffixes of ``s``, whose last letter is the only smallest one."""
    s = np.asarray(s)
    if len(s) <= 2:
        return np.arange(len(s))[::-1].copy()
    small = types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    buckets = _Buckets(s, small)
    rough = buckets.induce(lms)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    names = _names(s, order, lms)
    if names[-1] + 1 == len(lms):
        return buckets.induce(order)
    reduced = np.empty(len(s), np.int64)
    reduced[order] = names
    reduced = reduced[lms]
    deeper = suffix_array(reduced) if names[-1] < NAMES else _doubled(reduced)
    return buckets.induce(lms[deeper])


def permuted_prefixes(s: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in text order, the length of its common prefix with the suffix before it in sorted order, and that suffix.

    Only where the letters to the left differ is a prefix compared; elsewhere it is one shorter than that of the suffix to the left.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    index = np.arange(n)
    compared = before >= 0
    compared[1:] &= (before[1:] == 0) | (s[:-1] != s[before[1:] - 1])
    at = np.flatnonzero(compared)
    prefix = np.zeros(n, np.int64)
    wide = np.zeros(n + 8, np.uint64)
    letters = np.zeros(n + 16, np.uint64)
    letters[:n] = s
    for k in range(4):  # four letters in a word
        wide |= letters[k:k + n + 8] << np.uint64(16 * k)
    a, b, live = at.copy(), before[at], at
    while len(live):
        same = (wide[a] == wide[b]) & (a + 4 < n) & (b + 4 < n)
        rest = np.flatnonzero(~same)
        for k in range(4):
            a_k, b_k = np.minimum(a[rest] + k, n - 1), np.minimum(b[rest] + k, n - 1)
            more = (letters[a_k] == letters[b_k]) & (a[rest] + k < n) & (b[rest] + k < n)
            rest = rest[more]
            prefix[live[rest]] += 1
        prefix[live[same]] += 4
        live, a, b = live[same], a[same] + 4, b[same] + 4
    known = compared | (before < 0)
    last = np.maximum.accumulate(np.where(known, index, 0))
    return np.maximum(prefix[last] - (index - last), 0), before


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the places where a string of ``length`` bytes starts that also starts elsewhere in the texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(sizes.sum()) + len(texts)
    s = np.ones(total + 1, np.uint16)  # 1 parts texts, 0 ends all
    s[-1] = 0
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    inside = np.ones(total + 1, bool)
    inside[ends] = inside[-1] = False
    s[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 2
    prefix, before = permuted_prefixes(s, suffix_array(s))
    hit = np.zeros(total + 1, bool)
    long = np.flatnonzero(prefix >= length)
    hit[long] = hit[before[long]] = True
    room = np.repeat(ends, sizes + 1)  # a string must end inside its text
    hit[:-1] &= np.arange(total) + length <= room
    return [np.flatnonzero(hit[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
