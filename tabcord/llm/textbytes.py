"""Words of many texts at once, as arrays over one byte buffer.

Helpers that run inside tasks.  Texts are handled in blocks of bounded size,
so memory does not depend on the number of rows in a batch; a text larger than
a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20

#: Bytes of a word in the sense of a bag of words: ASCII letters, digits and all bytes beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    ALNUM[_first : _last + 1] = True

#: Bytes of a word in the sense of ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

_RANDOM = np.random.default_rng(0x5EED)
_BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same codes with A-Z as a-z.
_FOLDED_CODE = _BYTE_CODE.copy()
_FOLDED_CODE[65:91] = _BYTE_CODE[97:123]
_PLACE_CODE = _RANDOM.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield first, i
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit codes evenly (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a block: 64-bit ``code``, ``text`` index, byte ``start`` and ``end`` in ``buffer``."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray, fold: bool = False):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        inside = word_bytes[self.buffer]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(before & ~inside)
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        #: The first word of each text, and the number of words after the last.
        self.bounds = np.searchsorted(self.start, self.text_start)
        if not len(self.start):
            self.code = np.empty(0, np.uint64)
            return
        place = np.arange(len(self.buffer))
        lead = np.zeros(len(self.buffer), np.int64)
        lead[self.start] = self.start
        place -= np.maximum.accumulate(lead)
        values = (_FOLDED_CODE if fold else _BYTE_CODE)[self.buffer] * _PLACE_CODE[place & 4095]
        values[~inside] = 0
        self.code = mix(np.add.reduceat(values, self.start))
        self._values, self._place = values, place

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of the first ``size`` bytes of every word that is longer."""
        long = np.flatnonzero(self.end - self.start > size)
        if not len(long):
            return self.text[long], np.empty(0, np.uint64)
        head = np.where(self._place < size, self._values, np.uint64(0))
        return self.text[long], mix(np.add.reduceat(head, self.start)[long] + np.uint64(size))


class Numbers(dict):
    """Numbers of distinct things in order of first sight; the new ones are listed."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, thing):
        number = self[thing] = len(self)
        self.new.append(thing)
        return number


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
