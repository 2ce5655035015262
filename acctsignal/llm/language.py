"""Language of a text by n-gram filters that answer for all languages at once.

A Bloom filter is kept bit-sliced: each of its positions holds one bit per language. Looking up an
n-gram reads a few positions and ANDs them, which gives the set of all languages that may contain it.
A text's language is the one whose bit is set for most of its n-grams, after the share of hits that a
filter of that fill gives by chance is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctsignal.llm.batches import below_share, forget, in_chunks, mix64
from acctsignal.session import materialize

#: Lengths of the character n-grams; a word's edge counts as one character.
ORDERS = (2, 3, 4, 5)
UNDETERMINED = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts as code points, every run of others as one 0; and where each text starts."""
    encoded = [f"\n{t.lower()}\n".encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(encoded), np.uint32).copy()
    codes[~_letters()[codes]] = 0
    starts = np.cumsum([0, *(len(e) // 4 for e in encoded[:-1])])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    keep[starts] = True
    return codes[keep], np.cumsum(keep)[starts] - 1


def ngram_hashes(codes: np.ndarray, order: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (from ``first`` up to before ``last``) and hash of the n-grams that lie within one word and its edges."""
    last = min(last, len(codes) - order + 1)
    if last <= first:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.ones(last - first, bool)
    for k in range(1, order - 1):
        inside &= codes[first + k:last + k] != 0
    edges = (codes[first:last] != 0) | (codes[first + order - 1:last + order - 1] != 0)
    at = np.flatnonzero(inside & edges) + first
    value = np.full(len(at), np.uint64(order))
    for k in range(order):
        value = value * _STEP + codes[at + k]
    return at, mix64(value)


@dataclass(frozen=True)
class LanguageFilters:
    """``words[p]`` has bit l set if position p belongs to language l; ``fill`` is each language's chance hit."""

    languages: tuple[str, ...]
    words: np.ndarray
    fill: np.ndarray
    lookups: int

    @classmethod
    def build(cls, languages: list[str], grams: np.ndarray, masks: np.ndarray, bits: int, lookups: int):
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= np.iinfo(k).bits)
        words = np.zeros(1 << bits, kind)
        model = cls(tuple(languages), words, np.zeros(len(languages)), lookups)
        for position in model.positions(grams):
            np.bitwise_or.at(words, position, masks.astype(kind))
        for i in range(len(languages)):
            model.fill[i] = np.mean((words >> kind(i)) & kind(1)) ** lookups
        return model

    def positions(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        """The positions of each n-gram, one array per lookup."""
        bits = np.uint64(len(self.words).bit_length() - 1)
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(self.lookups):
            yield ((hashes + np.uint64(k) * step) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the bit set of the languages that contain it."""
        found = None
        for position in self.positions(hashes):
            found = self.words[position] if found is None else found & self.words[position]
        return found

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each text's n-grams that each language contains; whether the text has a letter."""
        codes, starts = letter_runs(texts)
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for first in range(0, len(codes), _AT_ONCE):
            for order in ORDERS:
                at, hashes = ngram_hashes(codes, order, first, first + _AT_ONCE)
                if not len(at):
                    continue
                of = np.searchsorted(starts, at, "right") - 1
                total += np.bincount(of, minlength=len(texts))
                masks = self.containing(hashes)
                for i in range(len(self.languages)):
                    hits[:, i] += np.bincount(of, (masks >> masks.dtype.type(i)) & masks.dtype.type(1),
                                              minlength=len(texts))
        by_chance = total[:, None] * self.fill
        corrected = np.clip((hits - by_chance) / (1 - self.fill), 0, None)
        has_letter = np.add.reduceat(codes != 0, starts) > 0 if len(starts) else np.zeros(0, bool)
        return corrected / np.maximum(total, 1)[:, None], has_letter


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, count), summed over each chunk of a batch before it is sent."""
    forget()
    for batch in batches:
        table = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "text": batch.column("text").to_pylist()})
        for lang, texts in table.groupby("lang")["text"]:
            for _, chunk in in_chunks(list(texts)):
                codes, _ = letter_runs(chunk)
                hashes = np.concatenate([ngram_hashes(codes, n, 0, len(codes))[1] for n in ORDERS])
                grams, counts = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)),
                     pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *,
                  rows_per_language: int = 3000, most_languages: int = 64, least_share: float = 2e-6,
                  near_best: float = 0.5, bits: int = 22, lookups: int = 3) -> LanguageFilters:
    """Learn filters from labelled rows.

    The sample is bounded: about ``rows_per_language`` rows of each language, chosen by a hash of key and
    text. An n-gram goes into a language's filter if it makes up at least ``least_share`` of its n-grams (so
    there are at most 1/least_share of them) and at least ``near_best`` of the share it has in any language.
    Rows without text or language are left out. More than ``most_languages`` languages are an error; an empty
    table gives filters without languages, which call every text undetermined.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in
             rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return LanguageFilters((), np.zeros(1, np.uint8), np.zeros(0), lookups)
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("lang") == name) & below_share(rows_per_language / n, F.col("key"), F.col("text")))
    counts = materialize(  # read twice: for the totals, and for the filters
        rows.where(chosen).select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    languages = list(sizes)  # the most frequent first: it wins ties
    bit = F.lit(0)
    for i, name in enumerate(languages):
        bit = F.when(F.col("lang") == name, F.lit(i)).otherwise(bit)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = F.lit(1)
    for name, n in totals.items():
        total = F.when(F.col("lang") == name, F.lit(n)).otherwise(total)
    shares = counts.select("gram", bit.alias("bit"), (F.col("n") / total).alias("share"))
    masks = (shares.where(F.col("share") >= least_share).groupBy("gram")
             .agg(F.collect_list(F.struct("bit", "share")).alias("all"), F.max("share").alias("best"))
             .select("gram", F.aggregate("all", F.lit(0).cast("long"), lambda mask, x: F.when(
                 x["share"] >= near_best * F.col("best"),
                 mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"]))).otherwise(mask)).alias("mask"))
             .toArrow())
    return LanguageFilters.build(languages, masks["gram"].to_numpy().view(np.uint64),
                                 masks["mask"].to_numpy().view(np.uint64), bits, lookups)


def predict_language(model: LanguageFilters, text: Column) -> Column:
    """struct(lang_pred, score) of a text.

    A null text, one without a letter, and any text if no language was learned, is ``und`` with score 0.
    Otherwise the language with the largest corrected share; its part of all languages' shares is the score
    (0 if no n-gram is known: then the most frequent language).
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for _, chunk in in_chunks([t or "" for t in texts]):
            if not model.languages:
                names += [UNDETERMINED] * len(chunk)
                scores += [0.0] * len(chunk)
                continue
            shares, has_letter = model.shares(chunk)
            best, sums = shares.argmax(axis=1), shares.sum(axis=1)
            names += [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter)]
            scores += np.where(has_letter & (sums > 0), shares.max(axis=1) / np.where(sums > 0, sums, 1), 0.0).tolist()
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    return predict(text)
