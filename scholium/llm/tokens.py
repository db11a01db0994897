"""Tokenizer access: exact ids of the tokenizers library, found once per distinct word.

Byte-pair merging works inside pre-tokens, so the ids of a text are the ids of its
pre-tokens in order. :class:`WordCachedEncoder` finds pre-token boundaries of a whole
batch with array operations, asks the library's model only for pre-tokens not yet seen by
this worker, and gathers the rest from a hash table in arrays. Every pre-token found by its
hash is compared with the stored characters; a text where one differs goes to the library
whole, like texts with a character at or beyond U+0250. So the ids are exact.
"""

from __future__ import annotations

import unicodedata

import numpy as np

WIDE = 0x250
SEPARATOR = chr(0xE000)
END, LETTER, NUMBER, OTHER, SPACE = range(5)
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def vocabulary_path(path: str | None = None, name: str = "byte_bpe_50k.json") -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    table = np.full(WIDE + 1, OTHER, np.uint8)
    for c in range(WIDE):
        kind = unicodedata.category(chr(c))[0]
        table[c] = SPACE if c in WHITE_SPACE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[WIDE] = END
    return table


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_MULTIPLIER, _INVERSE))
        return self.up, self.down


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end]; the codes are already scrambled 64-bit values."""
    up, down = POWERS.need(len(codes) + 1)
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it prints, and the others as the letters from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class HashTable:
    """Numbers of 64-bit keys, by open addressing in arrays."""

    def __init__(self, bits: int = 16):
        self.size = 0
        self._allocate(bits)

    def _allocate(self, bits: int) -> None:
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)  # 0 marks a free place
        self.numbers = np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where it is not held."""
        at = keys.view(np.int64) & self.mask
        held = self.keys[at]
        out = np.where(held == keys, self.numbers[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys[at]
            same = held == keys[left]
            out[left[same]] = self.numbers[at[same]]
            go_on = ~same & (held != 0)
            left, at = left[go_on], at[go_on]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers, in order, of distinct keys that are not held yet."""
        new = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        if 2 * (self.size + len(keys)) > len(self.keys):
            old, numbers = self.keys[self.keys != 0], self.numbers[self.keys != 0]
            self._allocate(int(4 * (self.size + len(keys))).bit_length())
            self._put(old, numbers)
        self._put(keys, new)
        self.size += len(keys)
        return new

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = keys.view(np.int64) & self.mask
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = free & (self.keys[at] == keys)  # of keys that meet at one free place the last stays
            self.numbers[at[won]] = numbers[won]
            keys, numbers, at = keys[~won], numbers[~won], (at[~won] + 1) & self.mask


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.all, self.size = np.zeros(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.all):
            self.all = np.concatenate([self.all, np.zeros(max(need - len(self.all), len(self.all) // 2), self.all.dtype)])
        self.all[self.size : need] = values
        self.size = need


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of stretches of ``counts`` places, one stretch after another."""
    total = int(counts.sum())
    return np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(total)


class WordCachedEncoder:
    """Ids of whole texts; ``most_words`` and ``most_chars`` bound the pre-tokens that a worker remembers."""

    def __init__(self, path: str | None = None, most_words: int = 1_000_000, most_chars: int = 16_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.tokenizer.encode_special_tokens = True
        self.letters = _byte_letters()
        self.most_words, self.most_chars = most_words, most_chars
        self.classes = _classes()
        self.codes = mix(np.arange(1, WIDE + 2, dtype=np.uint64) * _MULTIPLIER)
        self._forget()

    def _forget(self) -> None:
        self.table = HashTable()
        self.ids, self.chars = Growing(np.uint32), Growing(np.uint16)
        self.begin, self.count, self.place, self.length = (Growing(np.int32) for _ in range(4))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, words: list[str], chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Remember new pre-tokens; ``chars`` are their characters one after another."""
        model, letters = self.tokenizer.model, self.letters
        coded = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]
        counts = np.fromiter(map(len, coded), np.int32, len(coded))
        self.begin.extend(self.ids.size + np.cumsum(counts) - counts)
        self.count.extend(counts)
        self.ids.extend(np.fromiter((i for c in coded for i in c), np.uint32, int(counts.sum())))
        self.place.extend(self.chars.size + np.cumsum(lengths) - lengths)
        self.length.extend(lengths)
        self.chars.extend(chars)
        return self.table.add(hashes)

    def _boundaries(self, chars: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Starts of pre-tokens; separators count as pre-tokens of kind END."""
        before, after = np.empty_like(kinds), np.empty_like(kinds)
        before[0], before[1:] = END, kinds[:-1]
        after[-1], after[:-1] = END, kinds[1:]
        blank = chars == 32
        glued = np.empty_like(blank)
        glued[0], glued[1:] = False, blank[:-1]
        solid = (kinds != SPACE) & (kinds != END)
        starts = solid & (before != kinds) & ~glued
        starts |= (kinds == SPACE) & ((before != SPACE) | ((after != SPACE) & (after != END)))
        starts |= kinds == END
        apostrophes = np.flatnonzero((chars == 39) & (before != OTHER) & ~glued)
        if len(apostrophes):
            padded = np.concatenate([chars, np.zeros(3, chars.dtype)])
            one, two = padded[apostrophes + 1], padded[apostrophes + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            for at, width in ((apostrophes[short], 2), (apostrophes[long & ~short], 3)):
                starts[at + 1] = False
                if width == 3:
                    starts[at + 2] = False
                following = at + width
                following = following[following < len(chars)]
                starts[following[solid[following] & (kinds[following] == LETTER)]] = True
        return np.flatnonzero(starts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One uint32 array of ids per text."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text) + 1
            if size > 1_000_000:
                out += self._encode(group)
                group, size = [], 0
        return out + (self._encode(group) if group else [])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = SEPARATOR.join(texts) + SEPARATOR
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        clipped = np.minimum(chars, WIDE).astype(np.uint16)
        wide = clipped == WIDE
        wide[ends] = False
        rare = np.add.reduceat(wide, ends - lengths, dtype=np.int64) > 0
        for k in np.flatnonzero(rare):
            clipped[ends[k] - lengths[k] : ends[k]] = WIDE
        kinds = self.classes[clipped]
        starts = self._boundaries(clipped, kinds)
        stops = np.append(starts[1:], len(chars))
        real = kinds[starts] != END
        starts, stops = starts[real], stops[real]
        if self.table.size > self.most_words or self.chars.size > self.most_chars:
            self._forget()
        hashes = span_hashes(self.codes[clipped], starts, stops)
        hashes[hashes == 0] = 1
        sizes, flat = stops - starts, clipped[kinds != END]  # pre-tokens follow each other without a gap
        words = self.table.find(hashes)
        if len(unknown := np.flatnonzero(words < 0)):
            distinct, first, back = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            new = unknown[first]
            named = [joined[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]
            words[unknown] = self._learn(distinct, named, clipped[spread(starts[new], sizes[new])], sizes[new])[back]
        of = np.searchsorted(ends, starts)
        differs = sizes != self.length.all[words]
        if differs.any():  # two pre-tokens of one hash
            rare[of[differs]] = True
        same = np.where(differs, 0, sizes)
        seen = self.chars.all[spread(self.place.all[words], same)] == (flat if not differs.any() else flat[np.repeat(~differs, sizes)])
        if not seen.all():
            rare[of[np.repeat(np.arange(len(words)), same)[~seen]]] = True
        counts = self.count.all[words].astype(np.int64)
        ids = self.ids.all[spread(self.begin.all[words], counts)]
        totals = np.bincount(of, weights=counts, minlength=len(texts)).astype(np.int64)
        out = np.split(ids, np.cumsum(totals)[:-1])
        if len(whole := np.flatnonzero(rare)):
            for k, got in zip(whole, self._library([texts[k] for k in whole]), strict=True):
                out[k] = np.array(got, np.uint32)
        return out


_ENCODERS: dict[str, WordCachedEncoder] = {}


def encoder(path: str | None = None) -> WordCachedEncoder:
    """This worker's encoder; it lives as long as the Python worker does."""
    at = vocabulary_path(path)
    if at not in _ENCODERS:
        _ENCODERS[at] = WordCachedEncoder(at)
    return _ENCODERS[at]
