"""Operator 9: language identification by hierarchical discrimination.

A first set of linear support vector machines predicts the language family; within a
family, one-versus-one machines separate its languages. Inputs are the relative
frequencies of hashed character 1-, 2- and 3-grams of the whole text (case folded,
everything but letters as one blank), so a machine's decision is a mean of weights over
places and prediction is one gather per place.

The machines are fitted on at most ``most_rows`` labelled rows: the same number for each
language and one at least, first by a hash of the id. That is the only limit: every value
of ``lang`` is learned, from whole texts. Tasks count the n-grams of the chosen texts and
the driver gets the counts alone. Prediction covers every row.

Defined cases: null text and texts without a letter give ``und`` with score 0; with no
usable label everything is ``und``, with one language every text with a letter is that
language; of labelled rows that share id and language the least text is learned, rows
without an id are not learned from; a null id is not held out; rows that repeat get equal predictions; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.llm.shared import given_back, release, sent_id
from scholium.llm.tokens import LETTER, WIDE, _classes, mix
from scholium.llm.words import chunks

BITS = 13
#: Two decisions at chance (family, then language) score 0.25; the lowest score of a row of check_s or check_l was 0.323.
LEAST_SCORE = 0.3
UNKNOWN = "und"
# Families of common language codes; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "indic": "hi bn mr gu pa ur ne",
    "turkic": "tr az kk uz ky",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def lowest_hashes(frame: DataFrame, group: str, order: str, each: int, counts: dict) -> DataFrame:
    """The rows that may be among the ``each`` lowest of their group by a 64-bit hash column.

    A group of n rows keeps those below twice the share each / n (and a margin), so that what a ranking
    gathers by group is bounded by the sample and not by the group.
    """
    bound = F.lit(None).cast("long")
    for value, n in counts.items():
        share = min(1.0, (2 * each + 64) / max(1, n))
        bound = F.when(F.col(group) == value, F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))).otherwise(bound)
    return frame.filter(F.col(order) <= bound)


class Grams:
    """Hashed n-gram places of texts: (grams, places per text, letters per text) by chunk."""

    def __init__(self):
        kinds = _classes()
        lower = [ord(x) if len(x := chr(c).lower()) == 1 and ord(x) < WIDE else c for c in range(WIDE)]
        self.table = np.array([lower[c] if kinds[c] == LETTER else 32 for c in range(WIDE)] + [32], np.uint64)

    def __call__(self, texts: list[str]):
        for _, group in chunks(texts, 1 << 18):
            chars = np.frombuffer(("\n" + "\n".join(group) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = self.table[np.minimum(chars, WIDE)]
            if (wide := np.flatnonzero(chars >= WIDE)).size:
                values, back = np.unique(chars[wide], return_inverse=True)
                codes[wide] = np.array([ord(chr(v).lower()[0]) if chr(v).isalpha() else 32 for v in values.tolist()], np.uint64)[back]
            lengths = np.fromiter(map(len, group), np.int64, len(group))
            starts = np.cumsum(lengths + 1) - lengths
            one = codes[1:-1]
            two = one << np.uint64(21) | codes[2:]
            three = codes[:-2] << np.uint64(42) | two
            grams = np.stack([mix(x + np.uint64(k)) >> np.uint64(64 - BITS) for k, x in enumerate((one, two, three))], 1)
            letters = np.add.reduceat((codes != 32).astype(np.int64), starts)
            letters[lengths == 0] = 0
            yield grams.astype(np.int32), starts - 1, lengths, letters


def fit_machine(x: np.ndarray, y: np.ndarray, steps: int = 120, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge) by accelerated gradient steps; y is +1 or -1."""
    d = x.shape[1]
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, look, bias, look_b = np.zeros(d, np.float32), np.zeros(d, np.float32), np.float32(0), np.float32(0)
    rate = np.float32(0.5 / (float(share @ np.einsum("ij,ij->i", x, x)) + 1 + penalty))
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ look + look_b)) * share * y
        new, new_b = look + 2 * rate * (x.T @ slack) - rate * penalty * look, look_b + 2 * rate * slack.sum()
        look, look_b = new + np.float32((t - 1) / (t + 2)) * (new - w), new_b + np.float32((t - 1) / (t + 2)) * (new_b - bias)
        w, bias = new, new_b
    return w, float(bias)


@dataclass
class Vote:
    """One-versus-one machines between ``labels``; column j of the weights separates pairs[j]."""

    labels: list[str]
    pairs: list[tuple[int, int]]
    columns: list[int]


@dataclass
class LanguageModel:
    top: Vote
    within: dict[str, Vote]
    weights: np.ndarray
    biases: np.ndarray
    slopes: np.ndarray

    def decide(self, texts: list[str], grams: Grams) -> tuple[list[str], list[float]]:
        labels: list[str] = []
        scores: list[float] = []
        for places, starts, lengths, letters in grams(texts):
            sums = np.zeros((len(lengths), self.weights.shape[1]))
            filled = np.flatnonzero(lengths > 0)
            if len(filled) and self.weights.shape[1]:
                # Separators lie between texts: each text's stretch ends before its own.
                edges = np.stack([starts[filled], starts[filled] + lengths[filled]], 1).ravel()
                for c in range(0, self.weights.shape[1], 16):  # many languages have many machines
                    some = np.ascontiguousarray(self.weights[:, c : c + 16])
                    weight = some[places[:, 0]] + some[places[:, 1]] + some[places[:, 2]]
                    sums[filled, c : c + 16] = np.add.reduceat(np.concatenate([weight, np.zeros((1, weight.shape[1]), weight.dtype)]), edges)[::2]
            margins = (sums / np.maximum(lengths, 1)[:, None] + self.biases) * self.slopes
            chance = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
            for k, n in enumerate(letters.tolist()):
                if n == 0 or not self.top.labels:
                    labels.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                family, p = self._best(self.top, chance[k])
                language, q = self._best(self.within[family], chance[k])
                labels.append(language)
                scores.append(float(min(1.0, max(0.0, p * q))))
        return labels, scores

    @staticmethod
    def _best(vote: Vote, chance: np.ndarray) -> tuple[str, float]:
        if len(vote.labels) == 1:
            return vote.labels[0], 1.0
        got = np.zeros(len(vote.labels))
        for (a, b), j in zip(vote.pairs, vote.columns, strict=True):
            got[a] += chance[j]
            got[b] += 1 - chance[j]
        return vote.labels[int(got.argmax())], float(got.max() / (len(vote.labels) - 1))


def gram_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each text: the n-grams it has, their relative frequencies and its letters."""
    for places, starts, lengths, letters in Grams()(texts):
        for s, n, many in zip(starts.tolist(), lengths.tolist(), letters.tolist(), strict=True):
            count = np.bincount(places[max(0, s) : s + n].ravel(), minlength=1 << BITS) if n else np.zeros(1 << BITS, np.int64)
            held = np.flatnonzero(count)
            yield held.astype("<u2"), (count[held] / max(1, n)).astype("<f4"), many


def _counts(batches):
    for batch in batches:
        rows = [(lang, held.tobytes(), share.tobytes()) for lang, (held, share, letters) in zip(batch["lang"], gram_counts(list(batch["text"])), strict=True) if letters]
        yield pd.DataFrame(rows, columns=["lang", "held", "share"])


def fit_languages(x: np.ndarray, langs: list[str]) -> LanguageModel:
    """Fit the family machines and the one-versus-one machines within each family; ``x`` has a row of frequencies a text."""
    x = x.copy()
    scale = 1 / (np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-4) / np.float32(64) if len(x) else np.ones(1 << BITS, np.float32)
    x *= scale
    lang = np.array(langs, object)
    family = np.array([FAMILY_OF.get(v, v) for v in langs], object)
    weights, biases, slopes = [], [], []

    def vote(labels: list[str], of: np.ndarray) -> Vote:
        pairs, columns = [], []
        for i, a in enumerate(labels):
            for j in range(i + 1, len(labels)):
                use = (of == a) | (of == labels[j])
                y = np.where(of[use] == a, 1.0, -1.0)
                w, bias = fit_machine(x if use.all() else x[use], y)
                pairs.append((i, j))
                columns.append(len(weights))
                weights.append(w * scale)
                biases.append(bias)
                slopes.append(4.0)
        return Vote(labels, pairs, columns)

    top = vote(sorted(set(family)), family)
    within = {f: vote(sorted(set(lang[family == f])), np.where(family == f, lang, None)) for f in top.labels}
    stack = np.stack(weights, 1).astype(np.float32) if weights else np.zeros((1 << BITS, 0), np.float32)
    return LanguageModel(top, within, stack, np.array(biases), np.array(slopes))


def training_sample(docs: DataFrame, most_rows: int) -> tuple[np.ndarray, list[str]]:
    """(n-gram frequencies, languages) of at most ``most_rows`` labelled texts with a letter, as many of each language (one at least), by a hash of the id."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    usable = usable.select("doc_id", "lang", F.xxhash64(F.col("doc_id"), F.lit(11)).alias("order"))
    langs = usable.groupBy("lang").count().collect()
    each = max(1, most_rows // max(1, len(langs)))
    low = lowest_hashes(usable, "lang", "order", each, {r["lang"]: r["count"] for r in langs}).distinct()
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))).filter(F.col("rank") <= each)
    chosen = ranked.select(F.col("doc_id").alias("id"), F.col("lang").alias("of"))
    rows = docs.filter("text IS NOT NULL").join(F.broadcast(chosen), (docs["doc_id"] == chosen["id"]) & (docs["lang"] == chosen["of"]))
    rows = rows.groupBy("id", "of").agg(F.min("text").alias("text")).select("id", F.col("of").alias("lang"), "text")
    got = rows.mapInPandas(_counts, "lang string, held binary, share binary").collect()
    x = np.zeros((len(got), 1 << BITS), np.float32)
    # Rows in one order on every run: sums of floats depend on it.
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["held"]), bytes(r["share"])))
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["held"], "<u2")] = np.frombuffer(r["share"], "<f4")
    return x, [r["lang"] for r in got]


def fitted(docs: DataFrame, most_rows: int) -> LanguageModel:
    """The model of ``docs``, with the memory of its fitting given back."""
    model = fit_languages(*training_sample(docs, most_rows))
    release()
    return model


def _predictor(model: LanguageModel):
    def predict(batches):
        grams = Grams()
        for batch in batches:
            lang, score = model.decide([t or "" for t in batch["text"]], grams)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": lang, "score": score})

    return predict


def identify(spark: SparkSession, docs: DataFrame, most_rows: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""
    model = fitted(docs, most_rows)
    rows = docs.select(sent_id("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return given_back(rows.mapInPandas(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double"), "doc_id")


def keep_identified(spark: SparkSession, docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is predicted with a score of at least ``least``; ``und`` goes.

    Where no language could be learned, all rows stay. The score tells uncertain decisions, not junk: letter
    junk can lie near one language, and a single decision (one family, or a family a language) scores 0.5 at least.
    """
    model = fitted(docs, 2000)
    if not model.top.labels:
        return docs

    @F.pandas_udf("boolean")
    def identified(text: pd.Series) -> pd.Series:
        lang, score = model.decide([t or "" for t in text], Grams())
        return pd.Series([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)], dtype=bool)

    return docs.filter(identified("text"))
