"""Prefix-free parsing of byte texts, on arrays.

A rolling hash runs over all windows of ``TRIGGER`` bytes. The trigger of a string of ``width`` bytes is its window
with the least hash, the leftmost of equal ones; it depends on nothing but the string. A phrase is a maximal stretch of
a document whose ``width``-byte strings, at consecutive starts, share one trigger. Phrases overlap so that every string
lies in exactly one of them, and no phrase has another's beginning as a whole: equal strings are found at equal
offsets from equal triggers, whatever surrounds them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from boxtrail.llm.common import mix

TRIGGER = 32
PLACE_BITS = np.uint64(26)  # places in one block of text
MAX_BLOCK = 1 << 25
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _letters(base: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


_powers: dict = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for at least n places."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 20)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        _powers[base] = tuple(pair)
    return _powers[base]


class Rolling:
    """Hashes of any stretch of a byte array."""

    def __init__(self, raw: np.ndarray, base: int):
        up, self.down = _power(base, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_letters(base)[raw] * up[: len(raw)], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width : width + n] - self.sums[:n]) * self.down[:n])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


@dataclass
class Phrases:
    """Per phrase: its document's index, first and last string start, trigger start (all within the block)."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    trigger: np.ndarray
    name: np.ndarray  # hash of the trigger
    content: np.ndarray  # hash of the whole phrase and of where its trigger stands


def parse(raw: np.ndarray, sizes: np.ndarray, width: int) -> tuple[Phrases, Rolling]:
    """Phrases of documents that stand in ``raw`` in a row; shorter documents than ``width`` have none."""
    left, right = Rolling(raw, BASES[0]), Rolling(raw, BASES[1])
    grams = left.every(TRIGGER)
    if len(raw) < width:
        none = np.zeros(0, np.int64)
        return Phrases(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)), right
    least = (grams & ~((np.uint64(1) << PLACE_BITS) - np.uint64(1))) | np.arange(len(grams), dtype=np.uint64)
    span, have = width - TRIGGER + 1, 1
    while have < span:  # least of `have` neighbours, doubled until it spans the string
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    trigger = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(trigger)]
    start = np.flatnonzero(ends[doc] >= np.arange(len(trigger)) + width)  # strings stay inside their document
    trigger, doc = trigger[start], doc[start]
    cut = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])))) if len(start) else np.zeros(0, np.int64)
    first, trigger, doc = start[cut], trigger[cut], doc[cut]
    last = start[np.append(cut[1:], len(start)) - 1] if len(start) else first
    content = mix(right.some(first, last + width) + (trigger - first).astype(np.uint64) * np.uint64(BASES[0]))
    return Phrases(doc, first, last, trigger, grams[trigger], content), right
