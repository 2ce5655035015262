"""Text quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctsignal.llm.batches import Remembered, below_share, mix64

_RUNS = re.compile(r"(.)\1+", re.S)


class _Classes(dict):
    """Code point to the character that stands for its class, found when first asked for."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        found = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        self[code] = found
        return found


_CLASSES = _Classes()


def word_shape(word: str) -> str:
    """Letters become a or A and digits 0, equal neighbours are merged: ``Hello,`` is ``Aa,``."""
    return _RUNS.sub(r"\1", word.translate(_CLASSES))


def _hash_word(word: str) -> int:
    """crc32 of the lower-cased word in the upper half, of its shape in the lower."""
    shape = word_shape(word)
    return zlib.crc32(word.lower().encode("utf-8", "replace")) << 32 | zlib.crc32(shape.encode("utf-8", "replace"))


#: Known words of this Python worker.
_word_hashes = Remembered(lambda words: map(_hash_word, words))


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different slots of a text's n-grams, and the logarithms of their counts scaled to unit length.

    N-grams are of words (1, 2), of word shapes (1, 2, 3) and of repetitions (which of the next three words are
    the same word). Words are what white space separates. Null and empty texts have no slots.
    """
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    both = np.fromiter(_word_hashes.of(words), np.uint64, len(words))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    step = np.uint64(0x9E3779B97F4A7C15)
    grams = [word * np.uint64(8) + np.uint64(1), shape * np.uint64(8) + np.uint64(2)]
    pair = shape[:-1] * step + shape[1:]
    grams += [(word[:-1] * step + word[1:]) * np.uint64(8) + np.uint64(3), pair * np.uint64(8) + np.uint64(4),
              (pair[:-1] * step + shape[2:]) * np.uint64(8) + np.uint64(5)]
    same = np.zeros(len(words), np.uint64)
    for back in (1, 2, 3):
        same[back:] += (word[back:] == word[:-back]).astype(np.uint64) << np.uint64(back)
    grams.append(same * np.uint64(8) + np.uint64(6))
    slots = np.sort((mix64(np.concatenate(grams)) >> np.uint64(64 - bits)).astype(np.int32))
    first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
    counts = np.log1p(np.diff(np.r_[first, len(slots)]))
    return slots[first], counts / math.sqrt(float(counts @ counts))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


@dataclass
class FollowTheLeader:
    """Per-coordinate state of FTRL-proximal; weights are computed from it when they are needed."""

    bits: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self, slots: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= self.l1, 0.0,
                        (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        """One example; the last slot is the bias."""
        slots, values = np.r_[slots, 1 << self.bits], np.r_[values, 1.0]
        w = self.weights(slots)
        gradient = (_sigmoid(float(w @ values)) - label) * values
        n = self.n[slots]
        self.z[slots] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + gradient * gradient


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        slots, values = features(text, len(self.weights).bit_length() - 1)
        return _sigmoid(self.bias + float(self.weights[slots] @ values))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", *,
                most_rows: int = 16_384, rows_per_learner: int = 4_096, rounds: int = 10, bits: int = 18) -> QualityModel:
    """Learn from the labelled rows of ``docs``.

    The sample is bounded: about ``most_rows`` labelled keys, chosen by a hash of the key. Learners take about
    ``rows_per_learner`` rows each, in the order of a hash, ``rounds`` times; their weights are averaged.
    Several labels of one key count as their majority, as 1 in a tie. Keys or labels that are null and labels
    other than 0 and 1 are left out. Without a labelled row every text scores 0.5.
    """
    given = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
             .groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("label")))
    total = given.count()
    if not total:
        return QualityModel(np.zeros(1 << bits), 0.0)
    learners = max(1, math.ceil(min(total, most_rows) / rows_per_learner))
    chosen = given.where(below_share(most_rows / total, F.col("key")))
    sample = (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
              .join(F.broadcast(chosen), "key")  # at most about most_rows short rows
              .withColumn("order", F.xxhash64(F.lit(1), "key"))
              .withColumn("learner", F.pmod("order", F.lit(learners))))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "text"])
        model = FollowTheLeader(bits)
        known = [(*features(t, bits), int(y)) for t, y in zip(rows["text"], rows["label"])]
        for _ in range(rounds):
            for slots, values, y in known:
                model.learn(slots, values, y)
        w = model.weights(slice(None))
        used = np.flatnonzero(w)
        return pd.DataFrame({"slot": used, "weight": w[used]})

    found = (sample.select("learner", "order", "text", "label").groupBy("learner")
             .applyInPandas(learn, "slot long, weight double")
             .groupBy("slot").agg((F.sum("weight") / learners).alias("weight")).toArrow())
    weights = np.zeros((1 << bits) + 1)
    weights[found["slot"].to_numpy()] = found["weight"].to_numpy()
    return QualityModel(weights[:-1].copy(), float(weights[-1]))


def quality_score(model: QualityModel, text: Column) -> Column:
    """Probability that a text is good: the sigmoid of its sparse dot product with the weights.

    Null and empty texts score by the bias alone.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return score(text)
