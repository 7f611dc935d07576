"""Fingerprints of a post's own words.

A fingerprint has two parts. Weighted word samples (of each of many random orders of all words, the first word that the post
has, where frequent words come late) form a bit string whose blocks key the rotated tables: two posts share a sample with the
probability of their weighted word overlap. The second part counts the words that fall into each of many buckets, up to two,
in unary, so the bits in which two posts differ are the differences of their counts: an edited word changes at most two of
them, and posts that differ in more bits than that allows are no repeats. The bit difference never drops a repeat.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

#: Samples in a block, and blocks (one rotated table each).
SAMPLES, BLOCKS = 3, 40
#: Buckets of the counted words; a count takes two bits, so a fingerprint has 2 * BUCKETS bits, in WIDTH numbers of 64.
BUCKETS = 256
WIDTH = 2 * BUCKETS // 64
#: Words in fewer posts than 1/RARE_PART count as rare and weigh most; the rest weigh less the more frequent they are.
#: At most RARE_PART times the mean number of words of a post can be frequent. The least weight is high enough that
#: near-copies of one post still meet when they are so many that all its words are frequent.
RARE_PART, LEAST_WEIGHT = 2000, 0.4

_SEEN_WORDS = 30_000
#: Words handled at a time; longer posts are taken in parts of it.
_WORDS = 8192
_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(z: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each number."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * _MIX1
        z = (z ^ (z >> np.uint64(27))) * _MIX2
        return z ^ (z >> np.uint64(31))


class Fingerprinter:
    def __init__(self, frequent: dict[str, float]):
        """``frequent``: the part of all posts that has the word, for the frequent words."""
        scale = math.log(RARE_PART)
        self.weights = {w: max(LEAST_WEIGHT, min(1.0, -math.log(p) / scale)) for w, p in frequent.items()}
        self.steps = np.arange(1, SAMPLES * BLOCKS + 1, dtype=np.uint64) * _GOLD
        self.position = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
        self.block = _mixed(np.arange(BLOCKS, dtype=np.uint64) + np.uint64(1 << 32))
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.order = np.zeros((1024, SAMPLES * BLOCKS), dtype=np.uint64)
        self.bucket = np.zeros(1024, dtype=np.int64)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Rows of ``order`` and ``bucket`` that hold the words.

        ``order`` has the word's place in each random order (an exponential variate with the weight as rate; positive
        floats compare as their bits do) above its code, so that the least number names the first word.
        """
        if len(self.row) > _SEEN_WORDS:
            self._forget()
        row = self.row
        new = [w for w in dict.fromkeys(words) if w not in row]
        if new:
            start, end = len(row), len(row) + len(new)
            if end > len(self.bucket):
                more = max(end, 2 * len(self.bucket)) - len(self.bucket)
                self.order = np.concatenate([self.order, np.zeros((more, self.order.shape[1]), dtype=np.uint64)])
                self.bucket = np.concatenate([self.bucket, np.zeros(more, dtype=np.int64)])
            codes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in new], dtype=np.uint64)
            weights = np.array([self.weights.get(w, 1.0) for w in new])
            with np.errstate(over="ignore"):
                z = _mixed(codes[:, None] + self.steps)
            u = ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            place = (-np.log(u) / weights[:, None]).astype(np.float32).view(np.uint32).astype(np.uint64)
            self.order[start:end] = place << np.uint64(32) | (_mixed(codes) & _LOW)[:, None]
            self.bucket[start:end] = (codes >> np.uint64(48)).astype(np.int64) % BUCKETS
            row.update(zip(new, range(start, end), strict=True))
        return np.array([row[w] for w in words], dtype=np.int64)

    def __call__(self, posts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(block keys, bits) of each post, as signed 64-bit numbers in BLOCKS and WIDTH columns."""
        first = np.full((len(posts), SAMPLES * BLOCKS), np.iinfo(np.uint64).max, dtype=np.uint64)
        counts = np.zeros((len(posts), BUCKETS), dtype=np.int64)
        waiting: list[tuple[int, list[str]]] = []
        room = _WORDS

        def take() -> None:
            of = np.repeat([i for i, _ in waiting], [len(w) for _, w in waiting])
            rows = self._rows([w for _, part in waiting for w in part])
            own, nth = np.unique(of, return_inverse=True)
            counts[own] += np.bincount(nth * BUCKETS + self.bucket[rows], minlength=len(own) * BUCKETS).reshape(-1, BUCKETS)
            each = np.unique(nth * len(self.bucket) + rows)
            nth, rows = each // len(self.bucket), each % len(self.bucket)
            starts = np.flatnonzero(np.r_[True, nth[1:] != nth[:-1]])
            first[own] = np.minimum(first[own], np.minimum.reduceat(self.order[rows], starts, axis=0))

        for i, words in enumerate(posts):
            for at in range(0, len(words), _WORDS):
                part = words[at : at + _WORDS]
                if len(part) > room and waiting:
                    take()
                    waiting, room = [], _WORDS
                waiting.append((i, part))
                room -= len(part)
        if waiting:
            take()
        with np.errstate(over="ignore"):
            samples = (first & _LOW).reshape(len(posts), BLOCKS, SAMPLES)
            blocks = _mixed((samples * self.position).sum(axis=2, dtype=np.uint64) + self.block)
        bits = np.packbits(np.concatenate([counts >= 1, counts >= 2], axis=1), axis=1).view(np.int64)
        return blocks.view(np.int64), bits.reshape(len(posts), WIDTH)


def word_distance(a: list[str], b: list[str], most: int) -> int | None:
    """Least insertions, removals and replacements of single words that turn a into b, or None above ``most``.

    Follows the furthest reach of each diagonal, so the work grows with the distance, not with the product of lengths.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    code: dict[str, int] = {}
    x = [code.setdefault(w, len(code)) for w in a]
    y = [code.setdefault(w, len(code)) for w in b]
    reach: dict[int, int] = {}
    for e in range(most + 1):
        now: dict[int, int] = {}
        for d in range(-e, e + 1):  # diagonal: position in b minus position in a
            if e == 0:
                i = 0
            else:
                i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            if i < 0 or i + d < 0:
                continue
            i = min(i, n, m - d)
            if i < 0:
                continue
            while i < n and i + d < m and x[i] == y[i + d]:
                i += 1
            if d == m - n and i == n:
                return e
            now[d] = i
        reach = now
    return None


def repeats(a: list[str], b: list[str], part: int = 4) -> int | None:
    """The word distance if it is at most 1/part of the longer list, else None."""
    longer = max(len(a), len(b))
    most = longer // part
    counts: dict[str, int] = {}
    for w in a:
        counts[w] = counts.get(w, 0) + 1
    shared = 0
    for w in b:
        left = counts.get(w, 0)
        if left:
            counts[w] = left - 1
            shared += 1
    return word_distance(a, b, most) if longer - shared <= most else None
