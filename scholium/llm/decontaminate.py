"""Operator 8: benchmark decontamination by CGK embedding, bit-sampling LSH and exact verification.

Texts are compared as words (runs of letters and digits, case folded). A document matches
an item of n words when some stretch of it is within floor((1 - similarity) * n) word
edits. A CGK random walk maps a window of item size to a longer string in which edit
distance becomes Hamming distance; keys of a few sampled places collide for near windows.
How long walks are (one to three times the item), how many places make a key and how often
both are repeated follows for each item size from the agreement measured at the most edits
allowed (:func:`tuned`), so that a match at that limit is found with probability
``recall``; colliding windows are verified by exact semi-global edit distance.

Windows are first cut to those that can match at all: k edits destroy at most q k of an
item's n - q + 1 word q-grams (an insertion breaks q - 1 and pushes one beyond the window),
so a window with fewer benchmark q-grams than are left, or fewer different ones, cannot
match. It must also hold that many q-grams of one item of its size. These tests lose
nothing and keep walks off clean text. q is 3, or less for items too short to keep a
3-gram.

Items are a stated query set: they go to the tasks in blocks of ``block`` items. Defined
cases: null text and texts without words match nothing; items that are null or without
words are left out; items with one text match alike; null or repeated document ids give
their rows as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.shared import bounded_join, cut, given_back, release, sent_id
from scholium.llm.tokens import mix
from scholium.llm.words import LetterWords

SCHEMA = "doc_id long, item_id long, edits int, item_words int, start_word long, end_word long"


def grams(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams; none where there are fewer than q words."""
    out = words[: max(0, len(words) - q + 1)]
    for j in range(1, q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - q + 1 + j]
    return mix(out)


def gram_size(n: int, k: int) -> int:
    return next(q for q in (3, 2, 1) if n - q + 1 - q * k > 0)


def walk(windows: np.ndarray, salts: np.ndarray):
    """The words (windows x walks) at each step of CGK walks over rows of n words; 0 past the end."""
    count, n = windows.shape
    padded = np.concatenate([windows, np.zeros((count, 1), np.uint64)], 1).ravel()
    first = (np.arange(count) * (n + 1))[:, None]
    at = np.zeros((count, len(salts)), np.int64)
    for j in range(salts.shape[1]):
        word = padded[first + np.minimum(at, n)]
        yield word
        at += (((word ^ salts[:, j]) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(np.int64)


def edited(words: np.ndarray, k: int, kind: str, rng: np.random.Generator) -> np.ndarray:
    """``words`` after k edits of a kind, at random places or in one run."""
    n = len(words)
    new = rng.integers(1, 1 << 60, k).astype(np.uint64)
    if kind == "substitutions":
        words = words.copy()
        words[rng.choice(n, k, replace=False)] = new
        return words
    if kind.startswith("deletion"):
        return np.delete(words, rng.choice(n, k, replace=False) if kind == "deletions" else rng.integers(0, n - k + 1) + np.arange(k))
    return np.insert(words, np.sort(rng.integers(0, n + 1, k)) if kind == "insertions" else np.full(k, rng.integers(0, n + 1)), new)


KINDS = ("deletions", "deletion run", "insertions", "insertion run", "substitutions")


@lru_cache(maxsize=4096)
def tuned(n: int, k: int, samples: int, repeats: int, recall: float, pairs: int = 48, walks: int = 32) -> tuple[int, int, int]:
    """(steps, samples, repeats) that find an item of n words after k edits with probability ``recall``.

    Measured on made items after k edits of each kind, over the windows that pass the q-gram test (at most nine
    of them; padding does not count as agreement). The most samples, up to ``samples``, that need at most
    ``repeats`` repeats are taken; a single sample is repeated as often as it takes.
    """
    rng = np.random.default_rng([n, k])
    q = gram_size(n, k)
    salts = rng.integers(1, 1 << 63, (walks, 3 * n), dtype=np.uint64)
    shifts = np.unique(np.linspace(-k, k, min(9, 2 * k + 1)).round().astype(int))
    agreements: dict[int, list[np.ndarray]] = {n: [], 2 * n: [], 3 * n: []}
    for kind in KINDS:
        items, windows, hopeful = [], [], []
        for _ in range(pairs):
            item = rng.integers(1, 1 << 60, n).astype(np.uint64)
            text = np.concatenate([rng.integers(1, 1 << 60, k).astype(np.uint64), edited(item, k, kind, rng), rng.integers(1, 1 << 60, n + 2 * k + q).astype(np.uint64)])
            held = np.isin(grams(text, q), grams(item, q))
            items.append(item)
            windows += [text[k + s : k + s + n] for s in shifts]
            hopeful.append([held[k + s : k + s + n - q + 1].sum() >= n - q + 1 - q * k for s in shifts])
        agree = np.zeros((pairs, len(shifts), walks))
        for j, (own, other) in enumerate(zip(walk(np.stack(items), salts), walk(np.stack(windows), salts), strict=True), 1):
            own = own[:, None]
            agree += (other.reshape(agree.shape) == own) & (own > 0)
            if j in agreements:
                agreements[j].append(agree / j * np.array(hopeful)[:, :, None])

    def needed(steps: int, s: int) -> int:
        most = 1
        for agree in agreements[steps]:
            missed = 1 - (agree**s).max(1).mean(1)  # of each pair, by one repeat
            while (missed**most).mean() > 1 - recall:
                most += max(1, most // 16)
                if most > 100_000:
                    return most
        return most

    for s in range(samples, 0, -1):
        count, steps = min((needed(steps, s) * steps, steps) for steps in agreements)
        if count // steps <= repeats or s == 1:
            return steps, min(s, steps), count // steps
    raise ValueError("samples must be positive")


@dataclass
class Plan:
    """What tasks need: the items by length, their q-grams and the walks.

    ``samples`` and ``repeats`` are what :func:`tuned` prefers; it repeats more often where ``recall`` takes it.
    """

    items: list[tuple[int, np.ndarray]]
    similarity: float
    samples: int
    repeats: int
    seed: int
    recall: float = 0.995
    by_length: dict[int, list[int]] = field(init=False)

    def __post_init__(self):
        self.by_length = {}
        for k, (_, w) in enumerate(self.items):
            self.by_length.setdefault(len(w), []).append(k)
        self.size = {n: gram_size(n, self.edits(n)) for n in self.by_length}
        self.need = {n: n - q + 1 - q * self.edits(n) for n, q in self.size.items()}
        self.known: dict[int, np.ndarray] = {}
        self.kinds: dict[int, int] = {}
        for n, q in self.size.items():
            own = [np.unique(grams(self.items[k][1], q)) for k in self.by_length[n]]
            self.kinds[n] = max(1, min(map(len, own)) - q * self.edits(n))
            self.known[q] = np.unique(np.concatenate([self.known.get(q, np.zeros(0, np.uint64)), *own]))
        self.hosts = {q: self._hosts(q) for q in self.known}
        self.walks = {n: self._walks(n) for n in self.by_length}
        self.tables = {n: self._tables(ks) for n, ks in self.by_length.items()}

    def edits(self, n: int) -> int:
        return int(math.floor((1 - self.similarity) * n + 1e-9))

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """LSH keys, (windows x repeats), of the rows of ``windows`` (windows x n words)."""
        salts, at_step = self.walks[windows.shape[1]]
        out = np.empty((len(windows), len(salts)), np.uint64)
        each = max(1, 65_536 // len(salts))
        for a in range(0, len(windows), each):
            part = windows[a : a + each]
            key = np.repeat(np.arange(1, len(salts) + 1, dtype=np.uint64)[None], len(part), 0)
            for word, those in zip(walk(part, salts), at_step, strict=True):
                if len(those):
                    key[:, those] = mix(key[:, those] * np.uint64(0x9E3779B97F4A7C15) + word[:, those])
            out[a : a + each] = key
        return out

    def _walks(self, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Salts (repeats x steps) and, for each step, the repeats that sample it."""
        steps, samples, repeats = tuned(n, self.edits(n), self.samples, self.repeats, self.recall)
        rng = np.random.default_rng([self.seed, n])
        sampled = np.zeros((repeats, steps), bool)
        for row in sampled:
            row[rng.choice(steps, samples, replace=False)] = True
        last = int(np.flatnonzero(sampled.any(0))[-1]) + 1
        return rng.integers(1, 1 << 63, (repeats, last), dtype=np.uint64), [np.flatnonzero(c) for c in sampled.T[:last]]

    def _hosts(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The different q-grams of each item with that q, sorted, and their items."""
        own = [(k, np.unique(grams(w, q))) for k, (_, w) in enumerate(self.items) if self.size[len(w)] == q]
        values, owner = np.concatenate([g for _, g in own]), np.repeat([k for k, _ in own], [len(g) for _, g in own])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    def reaches(self, at: np.ndarray, values: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first, last offset) of the windows that hold as many q-grams of one item as it needs; ``at`` are the places of the benchmark's."""
        known, owner = self.hosts[q]
        lo, hi = np.searchsorted(known, values[at], "left"), np.searchsorted(known, values[at], "right")
        many = hi - lo
        item = owner[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
        place = np.repeat(at, many)
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        lengths = np.array([len(w) for _, w in self.items])[item]
        width = lengths - q + 1
        end = np.arange(len(item)) + np.array([self.need.get(n, 1) for n in range(max(self.need) + 1)])[lengths] - 1
        inside = np.minimum(end, len(item) - 1)
        fits = (end < len(item)) & (item[inside] == item) & (place[inside] - place < width)
        return item[fits], np.maximum(0, place[inside] - width + 1)[fits], place[fits]

    def _tables(self, ks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of items of one length, and their items."""
        keys = self.keys(np.stack([self.items[k][1] for k in ks]))
        owner = np.repeat(ks, keys.shape[1])
        keys = keys.ravel()
        order = np.argsort(keys, kind="stable")
        return keys[order], owner[order]

    def holds(self, values: np.ndarray, q: int) -> np.ndarray:
        """Whether each q-gram is one of the benchmark's."""
        known = self.known[q]
        return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values

    def hopeful(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts, words[bounds[k]:bounds[k+1]], with a stretch of the longest item's size that holds the fewest q-grams any item needs."""
        out = np.zeros(len(bounds) - 1, bool)
        for q in self.known:
            reach = max(n for n in self.size if self.size[n] == q)
            total = np.concatenate([[0], np.cumsum(self.holds(grams(words, q), q))])
            last = len(total) - 1
            dense = total[np.minimum(np.arange(last) + reach, last)] - total[:-1] >= min(self.need[n] for n in self.size if self.size[n] == q)
            marked = np.concatenate([[0], np.cumsum(dense)])
            out |= marked[np.minimum(bounds[1:], last)] > marked[np.minimum(bounds[:-1], last)]
        return np.flatnonzero(out)

    def survivors(self, held: np.ndarray, values: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
        """Offsets whose n-word window can match an item of n words; ``before`` is each q-gram's last place so far."""
        size, width = len(values), n - self.size[n] + 1
        total = np.concatenate([[0], np.cumsum(held)])
        fits = total[np.minimum(np.arange(size) + width, size)] - total[:size] >= self.need[n]
        if not fits.any():
            return np.zeros(0, np.int64)
        at = np.flatnonzero(held)
        change = np.bincount(np.maximum(before[at] + 1, at - width + 1).clip(0), minlength=size + 1) - np.bincount(at + 1, minlength=size + 1)
        return np.flatnonzero(fits & (np.cumsum(change)[:size] >= self.kinds[n]))

    def matches(self, texts: list[np.ndarray]) -> list[list[tuple]]:
        """For each text (as words): (item, edits, words, start, end) of every item that it holds, at its best place.

        Windows of all texts are embedded together, one item size at a time.
        """
        longest = max(self.by_length)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths + longest) - lengths - longest
        gap = np.zeros(longest, np.uint64)
        flat = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
        spots: dict[int, list[np.ndarray]] = {n: [] for n in self.by_length}
        can: set[tuple[int, int]] = set()
        for text, (words, begin) in enumerate(zip(texts, begins.tolist(), strict=True)):
            for q in self.known:
                values = grams(words, q)
                order = np.argsort(values, kind="stable")
                before = np.full(len(values), -1, np.int64)
                same = values[order][1:] == values[order][:-1]
                before[order[1:][same]] = order[:-1][same]
                held = self.holds(values, q)
                item, low, high = self.reaches(np.flatnonzero(held), values, q)
                can.update((text, k) for k in np.unique(item).tolist())
                lengths = np.array([len(w) for _, w in self.items])[item]
                for n in np.unique(lengths).tolist():
                    use = lengths == n
                    cover = np.cumsum(np.bincount(low[use], minlength=len(values) + 1) - np.bincount(high[use] + 1, minlength=len(values) + 1))
                    at = self.survivors(held, values, before, n)
                    if len(at := at[cover[at] > 0]):
                        spots[n].append(at + begin)
        found: dict[tuple[int, int], set[int]] = {}
        for n, parts in spots.items():
            offsets = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            sorted_keys, owner = self.tables[n]
            for a in range(0, len(offsets), 8192):
                part = offsets[a : a + 8192]
                keys = self.keys(flat[part[:, None] + np.arange(n)])
                lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
                for row, column in zip(*(x.tolist() for x in np.nonzero(hi > lo)), strict=True):
                    text = int(np.searchsorted(begins, part[row], "right")) - 1
                    for item in owner[lo[row, column] : hi[row, column]].tolist():
                        if (text, item) in can:
                            found.setdefault((text, item), set()).add(int(part[row] - begins[text]))
        out: list[list[tuple]] = [[] for _ in texts]
        for (text, item), starts in sorted(found.items()):
            item_id, pattern = self.items[item]
            n, k = len(pattern), self.edits(len(pattern))
            best, reach = None, -1
            for start in sorted(starts):
                if start <= reach:
                    continue
                reach = start + n // 2  # later starts lie in the stretch already searched
                a, b = max(0, start - k), min(len(texts[text]), start + n // 2 + n + k)
                hit = semi_global(pattern, texts[text][a:b])
                if hit[0] <= k and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1], a + hit[2])
            if best:
                out[text].append((item_id, best[0], n, best[1], best[2]))
        return out


def semi_global(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``text`` nearest to ``pattern``; the first and then shortest end wins."""
    m = len(text)
    row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for i, p in enumerate(pattern):
        down, across = row + 1, np.concatenate([[i + 1], row[:-1] + (text != p)])
        low = np.minimum(down, across)
        source = np.where(across <= down, np.concatenate([[0], origin[:-1]]), origin)
        # Insertions run along the row: a running minimum of low - position.
        level = low - steps
        run = np.minimum.accumulate(level)
        first = np.maximum.accumulate(np.where(level == run, steps, 0))
        row, origin = run + steps, source[first]
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


def _repeats(samples: int, agreement: float, recall: float) -> int:
    """Repeats that find a window whose embedding agrees in a known share of its places."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**samples))


def _finder(plan: Plan, names: list[str]):
    def find(batches):
        import pandas as pd

        read = LetterWords()
        for batch in batches:
            ids = list(zip(*(batch[c].tolist() for c in names), strict=True))
            whose, texts = [], []
            for first, words, counts in read([t or "" for t in batch["text"]]):
                bounds = np.concatenate([[0], np.cumsum(counts)])
                for k in plan.hopeful(words, bounds).tolist():
                    whose.append(ids[first + k])
                    texts.append(words[bounds[k] : bounds[k + 1]].copy())
            rows = [(*row, *m) for row, found in zip(whose, plan.matches(texts), strict=True) for m in found]
            release()
            out = pd.DataFrame(rows, columns=[*names, "item_id", "edits", "item_words", "start_word", "end_word"])
            yield out.astype({c: "int64" for c in out.columns if c != "digest"})

    return find


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, samples: int = 4, repeats: int = 64, recall: float = 0.995, block: int = 20_000, seed: int = 7) -> DataFrame:
    """One row per document and benchmark item that it holds: edits, the item's words, and where (in words, end exclusive)."""
    return _found(spark, docs.select(sent_id("doc_id"), "text"), benchmark, SCHEMA, Settings(similarity, samples, repeats, recall, block, seed))


@dataclass
class Settings:
    similarity: float = 0.8
    samples: int = 4
    repeats: int = 64
    recall: float = 0.995
    block: int = 20_000
    seed: int = 7


def _found(spark: SparkSession, rows: DataFrame, benchmark: DataFrame, schema: str, use: Settings) -> DataFrame:
    """The matches of ``rows`` with their columns besides the text."""
    names = [c for c in rows.columns if c != "text"]
    read, parts, items = LetterWords(), [], []

    def search(items: list) -> DataFrame:
        plan = Plan(items, use.similarity, use.samples, use.repeats, use.seed, use.recall)
        return rows.mapInPandas(_finder(plan, names), schema)

    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        words = np.concatenate([np.zeros(0, np.uint64), *(w for _, w, _ in read([r["text"]]))])
        if len(words):
            items.append((r["item_id"], words))
        if len(items) >= use.block:
            parts.append(search(items))
            items = []
    if items:
        parts.append(search(items))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return given_back(out, "doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; ids may be null or shared, so rows are told apart by id and text."""
    marked = docs.withColumn("__sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = marked.select(sent_id("doc_id"), F.col("__sha256").alias("digest"), "text")
    found = _found(spark, rows, benchmark, SCHEMA.replace("doc_id long", "doc_id long, digest string"), Settings())
    gone = cut(spark, found.select("doc_id", F.col("digest").alias("__sha256")).distinct())
    return bounded_join(marked, gone, ["doc_id", "__sha256"], "left_anti", 200_000).drop("__sha256")
