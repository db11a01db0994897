"""Operator 10: document quality by Bradley-Terry pairwise ranking.

Preference pairs (a text labelled 1 beats one labelled 0) give a linear score by logistic
loss on feature differences. The threshold is a quantile of the training scores, at the
share of label 0, and the reported score is the logistic of the distance to it.

Features are about fifty statistics of the whole text: sizes, shares of character kinds,
repetition of words and lines, word shapes, marks glued to words, function words. The ranking,
its scales and its threshold are fitted on every labelled row that is not held out; scoring
covers every row.

Defined cases: null text counts as empty, and empty texts get the score of their features;
without labels of both kinds every score is 0.5; labels are joined on non-null ids, and an
id with several labels counts as its smallest, and each row of an id as labelled; a null id is not held out; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.language import held_out
from scholium.llm.shared import cut, given_back, sent_id

GLUED = re.compile(r"\w[^\w\s'’.,;:!?)\]\"»-]")
SHOUT = re.compile(r"\b[^\W\d_a-z]{3,}\b")
MARKS = "|!?#$%&*@_<>{}[]=~^\\/+"


def features(text: str) -> np.ndarray:
    """Statistics of one whole text."""
    n = len(text)
    words = text.split()
    m = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.float64, m) if m else np.zeros(1)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if m else 0
    second = sum(c for _, c in counts.most_common(5)) if m else 0
    line_counts = Counter(lines)
    pairs = Counter(zip(words, words[1:], strict=False))
    letters = sum(map(str.isalpha, text)) if n < 200 else len(re.findall(r"[^\W\d_]", text))
    digits = len(re.findall(r"\d", text))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    blank = n - len("".join(words)) if m else n
    marks = [text.count(c) for c in MARKS]
    full = text.count(".")
    comma = text.count(",")
    stops = sum(w[-1] in ".!?" for w in words)
    length = max(1, n)
    many = max(1, m)
    out = [
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), m / max(1, len(lines)) / 100, sizes.mean() / 10, sizes.std() / 10, sizes.max() / 50,
        len(counts) / many, top / many, second / many, sum(a == b for a, b in zip(words, words[1:], strict=False)) / many,
        sum(c for c in pairs.values() if c > 1) / many, 1 - len(line_counts) / max(1, len(lines)), max(line_counts.values(), default=0) / max(1, len(lines)),
        letters / length, digits / length, upper / max(1, letters), blank / length, (n - letters - digits - blank) / length,
        len(GLUED.findall(text)) / many, len(SHOUT.findall(text)) / many, full / many, comma / many, stops / many,
        sum(w[0].isupper() for w in words) / many, sum(len(w) <= 3 for w in words) / many, sum(len(w) == 1 for w in words) / many,
        float(n == 0), float(m < 5), float(m < 20), float(text.rstrip()[-1:] in ".!?"),
    ]
    out += [min(1.0, 5 * c / many) for c in marks]
    return np.array(out, np.float32)


def expand(x: np.ndarray) -> np.ndarray:
    """Standardised features with squares, and clipped, so that no value rules alone."""
    z = np.clip(x, -4, 4)
    return np.concatenate([z, z * z / 4, np.tanh(4 * z)], 1)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) * self.scale) @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        return self.of(np.stack([features(t) for t in texts])) if texts else np.zeros(0)

    def of(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        z = (self.strength(x) - self.threshold) / self.spread
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_quality(x: np.ndarray, y: np.ndarray, share_of_zero: float, pairs: int = 20_000, steps: int = 400, penalty: float = 3e-3, seed: int = 5) -> QualityModel:
    """Bradley-Terry strengths from preference pairs, and the threshold by score quantile."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(1), np.ones(1), np.zeros(0), 0.0, 1.0)
    mean, scale = x.mean(0), 1 / (x.std(0) + 1e-3)
    z = expand((x - mean) * scale)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    diff = z[a] - z[b]
    w = look = np.zeros(z.shape[1])
    rate = 4 / max(1e-9, float((diff**2).sum(1).mean()))
    for t in range(1, steps + 1):
        lose = 1 / (1 + np.exp(np.clip(diff @ look, -30, 30)))
        new = look + rate * (diff.T @ lose / pairs - penalty * look)
        look = new + (t - 1) / (t + 2) * (new - w)
        w = new
    s = z @ w
    # The sample holds as many of each label as it can; weights bring label 0 back to its share.
    weight = np.where(y == 0, share_of_zero / len(bad), (1 - share_of_zero) / len(good))
    order = np.argsort(s, kind="stable")
    at = min(int(np.searchsorted(np.cumsum(weight[order]), share_of_zero)), len(s) - 2)
    threshold = float((s[order[at]] + s[order[at + 1]]) / 2)
    return QualityModel(mean, scale, w, threshold, max(1e-6, float(s[good].mean() - s[bad].mean()) / 8))


def _featurize(batches):
    import pandas as pd

    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "x": [features(t or "").tobytes() for t in batch["text"]]})


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1).astype(np.float64)


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Over all (label 1, label 0) pairs of some rows: their number, summed loss, gradient and Hessian of the logistic loss."""
    a, b = z[y == 1], z[y == 0]
    margin = np.clip((a @ w)[:, None] - (b @ w)[None, :], -30, 30)
    lose = 1 / (1 + np.exp(margin))
    bend = lose * (1 - lose)
    gradient = b.T @ lose.sum(0) - a.T @ lose.sum(1)
    cross = a.T @ bend @ b
    hessian = (a.T * bend.sum(1)) @ a + (b.T * bend.sum(0)) @ b - cross - cross.T
    return float(margin.size), float(np.log1p(np.exp(-margin)).sum()), gradient, hessian


def _added(batches):
    import pandas as pd

    total = 0
    for batch in batches:
        for blob in batch["sums"]:
            total = total + np.frombuffer(blob, np.float64)
    yield pd.DataFrame({"sums": [total.tobytes()] if isinstance(total, np.ndarray) else []}, dtype=object)


def _summed(tables: DataFrame, tasks: int) -> np.ndarray:
    """The sum of the arrays that ``tasks`` tasks give as blobs, in one job; of more than 16 tasks, groups are added up by tasks first."""
    if tasks > 16:
        tables = tables.repartition(math.isqrt(tasks)).mapInPandas(_added, "sums binary")
    return sum(np.frombuffer(r[0], np.float64) for r in tables.collect())


def _sums_of(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    """Each task's sums over all pairs of its buckets; rows come sorted by bucket."""

    def run(batches):
        import pandas as pd

        total, now, blobs, labels = 0, None, [], []

        def solved():
            y = np.array(labels)
            if not (y == 1).any() or not (y == 0).any():
                return 0
            n, loss, gradient, hessian = pair_sums(expand((_matrix(blobs) - mean) * scale), y, w)
            return np.concatenate([[n, loss], gradient, hessian.ravel()])

        for batch in batches:
            for bucket, quality, x in zip(batch["bucket"], batch["quality"], batch["x"], strict=True):
                if bucket != now:
                    total = total + solved()
                    now, blobs, labels = bucket, [], []
                blobs.append(x)
                labels.append(quality)
        total = total + solved()
        yield pd.DataFrame({"sums": [total.tobytes()] if isinstance(total, np.ndarray) else []}, dtype=object)

    return run


def _moments(batches):
    import pandas as pd

    for batch in batches:
        if len(batch):
            x = _matrix(batch["x"])
            yield pd.DataFrame({"sums": [np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]).tobytes()]})


def _strengths(model: QualityModel):
    def run(batches):
        import pandas as pd

        for batch in batches:
            s = model.strength(_matrix(batch["x"])) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"quality": batch["quality"], "s": s})

    return run


def order_statistic(values: DataFrame, name: str, k: int, gather: int = 10_000) -> float:
    """The k-th smallest value, from 0: ranges are counted and narrowed until few values are left."""
    low, high, n = values.agg(F.min(name), F.max(name), F.count(name)).first()
    while n > gather and low < high:
        step = (high - low) / 1024
        if low + step == low:
            break
        bins = values.filter(F.col(name).between(low, high)).groupBy(F.least(F.lit(1023), F.floor((F.col(name) - low) / step)).alias("bin"))
        for r in sorted(bins.agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect()):
            if k < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
    if low >= high or n > gather:
        return low
    return sorted(r[0] for r in values.filter(F.col(name).between(low, high)).select(name).collect())[k]


def fit_from_labels(spark: SparkSession, described: DataFrame, labels: DataFrame, size: int = 1024, fewest: int = 64, rounds: int = 30, penalty: float = 3e-3) -> QualityModel:
    """The model of every labelled row that is not held out; ``described`` has (doc_id, x) of all rows.

    Rows are dealt to buckets of about ``size``, equal rows of an id in turn, the rarer label's to several where needed
    for ``fewest`` of it in each, and Newton's method takes all pairs of a bucket. Tasks sum; the driver gets the sums.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).filter("id IS NOT NULL AND quality IN (0, 1)")
    known = known.filter(~held_out(F.col("id"), 3, 1)).groupBy("id").agg(F.min("quality").alias("quality"))
    rows = cut(spark, described.join(known, F.col("doc_id") == F.col("id")).select("id", "quality", "x"))
    many = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(many) < 2:
        return QualityModel(np.zeros(1), np.ones(1), np.zeros(0), 0.0, 1.0)
    n = sum(many.values())
    buckets = -(-n // size)
    # Passes take as many tasks as the buckets fill, four in each, however many partitions the shuffles made.
    tasks = -(-buckets // 4)
    rows = rows.coalesce(tasks)
    sums = _summed(rows.select("x").mapInPandas(_moments, "sums binary"), tasks)
    half = (len(sums) - 1) // 2
    mean = sums[1 : half + 1] / n
    scale = 1 / (np.sqrt(np.maximum(0, sums[half + 1 :] / n - mean * mean)) + 1e-3)
    copies = F.when(F.col("quality") == min(many, key=many.get), min(buckets, -(-fewest * buckets // min(many.values())))).otherwise(1)
    bucket = F.pmod(F.pmod(F.xxhash64("id", "x"), F.lit(buckets)) + F.col("same") + F.col("copy"), F.lit(buckets)).cast("int").alias("bucket")
    each = rows.groupBy("id", "quality", "x").agg(F.count(F.lit(1)).alias("n")).select("id", "quality", "x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("same"))
    copied = each.select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    dealt = cut(spark, copied.select("quality", "x", bucket).repartition(tasks, "bucket").sortWithinPartitions("bucket")).coalesce(tasks)
    w = np.zeros(3 * half)
    for _ in range(rounds):
        sums = _summed(dealt.mapInPandas(_sums_of(mean, scale, w), "sums binary"), tasks)
        gradient = sums[2 : 2 + len(w)] / sums[0] + penalty * w
        step = np.linalg.solve(sums[2 + len(w) :].reshape(len(w), -1) / sums[0] + penalty * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    model = QualityModel(mean, scale, w, 0.0, 1.0)
    scored = cut(spark, rows.select("quality", "x").mapInPandas(_strengths(model), "quality int, s double"))
    means = {r["quality"]: r["s"] for r in scored.groupBy("quality").agg(F.avg("s").alias("s")).collect()}
    model.threshold = (order_statistic(scored, "s", many[0] - 1) + order_statistic(scored, "s", many[0])) / 2
    model.spread = max(1e-6, (means[1] - means[0]) / 8)
    return model


def _scorer(model: QualityModel):
    def score(batches):
        import pandas as pd

        for batch in batches:
            s = model.of(_matrix(batch["x"])) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return score


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; each text is read once, for its features."""
    rows = docs.select(sent_id("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    described = cut(spark, rows.mapInPandas(_featurize, "doc_id long, held_out boolean, x binary"))
    model = fit_from_labels(spark, described, labels)
    return given_back(described.mapInPandas(_scorer(model), "doc_id long, held_out boolean, score double, predicted int"), "doc_id")
