"""Word hashes of many texts at once, as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from scholium.llm.tokens import LETTER, NUMBER, WIDE, _classes, mix

_GOLD = np.uint64(0x9E3779B97F4A7C15)
BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
for _c in range(65, 91):
    BYTE_CODES[_c] = BYTE_CODES[_c + 32]  # A-Z as a-z
BYTE_WHITE = np.zeros(256, bool)
BYTE_WHITE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20


class Places:
    """Scrambled place numbers, as far as asked for."""

    def __init__(self):
        self.codes = np.zeros(0, np.uint64)

    def need(self, n: int) -> np.ndarray:
        if len(self.codes) < n:
            self.codes = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * _GOLD)
        return self.codes


PLACES = Places()


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words codes[start:end]: sums of scrambled (character, place) pairs.

    Unlike a polynomial modulo 2**64, whose value repeats on patterned words of any odd multiplier, the terms of
    a sum have nothing in common from place to place; words collide as random 64-bit numbers do.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    place = inside - np.repeat(starts, sizes)
    terms = (codes[inside] ^ PLACES.need(int(sizes.max()))[place]) * np.uint64(0xBF58476D1CE4E5B9)
    terms ^= terms >> np.uint64(29)
    terms *= np.uint64(0x94D049BB133111EB)
    return mix(np.add.reduceat(terms, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``most`` characters, with the first one's index."""
    first, size, group = 0, 0, []
    for k, t in enumerate(texts):
        group.append(t)
        size += len(t)
        if size >= most:
            yield first, group
            first, size, group = k + 1, 0, []
    if group:
        yield first, group


def ascii_words(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each chunk of texts: hashes of its words (runs without ASCII white space, A-Z lowered) and words per text."""
    for _, group in chunks(texts):
        raw = [t.encode("utf-8", "surrogatepass") for t in group]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        starts, stops = runs(~BYTE_WHITE[data])
        hashes = word_hashes(BYTE_CODES[data], starts, stops)
        bounds = np.searchsorted(starts, ends)
        yield hashes, np.diff(bounds, prepend=0)


class LetterWords:
    """Words as runs of letters and digits in any case, for texts compared without punctuation."""

    def __init__(self):
        kinds = _classes()
        self.inside = np.zeros(WIDE + 1, bool)
        self.inside[:WIDE] = (kinds[:WIDE] == LETTER) | (kinds[:WIDE] == NUMBER)
        self.inside[WIDE] = True
        lower = [ord(x) if len(x := chr(c).lower()) == 1 and ord(x) < WIDE else c for c in range(WIDE)]
        self.codes = mix((np.array([*lower, WIDE], np.uint64) + np.uint64(1)) * _GOLD)

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the chunk's first text, word hashes, words per text)."""
        for first, group in chunks(texts):
            chars = np.frombuffer(("\n".join(group) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
            clipped = np.minimum(chars, WIDE)
            inside, codes = self.inside[clipped], self.codes[clipped]
            if (wide := np.flatnonzero(chars >= WIDE)).size:
                c = chars[wide]
                inside[wide] = ~(((c >= 0x2000) & (c < 0x2070)) | ((c >= 0x3000) & (c < 0x3040)))
                low = np.array([ord(x) if len(x := chr(v).lower()) == 1 else v for v in c.tolist()], np.uint64)
                codes[wide] = mix((low + np.uint64(1)) * _GOLD)
            starts, stops = runs(inside)
            yield first, word_hashes(codes, starts, stops), np.diff(np.searchsorted(starts, ends), prepend=0)
