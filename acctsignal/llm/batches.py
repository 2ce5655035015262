"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import weakref
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters handled at once inside a task, so that memory does not follow the Arrow batch.
CHARS_AT_ONCE = 400_000


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (upper or lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor


def below_share(share: float, *keys: Column) -> Column:
    """True for about ``share`` of the keys, decided by their hash: the same rows at every run."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def in_chunks(texts: Sequence[str], most: int = CHARS_AT_ONCE) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, consecutive texts) of about ``most`` characters together; a longer text comes alone."""
    first, chunk, size = 0, [], 0
    for i, text in enumerate(texts):
        if chunk and size + len(text) > most:
            yield first, chunk
            first, chunk, size = i, [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield first, chunk


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What this Python worker remembers; a worker goes on from stage to stage of a job.
_REMEMBERING: weakref.WeakSet[Remembered | Lookup] = weakref.WeakSet()


def forget(*but: Remembered | Lookup) -> None:
    """Give back the memory of what earlier stages remembered in this worker, ``but`` of what is still in use."""
    if sum(kept.clear() for kept in _REMEMBERING if not any(kept is b for b in but)):
        gc.collect()


class Remembered:
    """Values of strings, kept for the strings that come again.

    ``function`` gives the values of a list of different strings. Memory is bounded: strings are first kept among
    the young; those met again in a later call move to the old. Either set is forgotten when it has ``most``
    entries, so that frequent strings stay and rare ones go.
    """

    def __init__(self, function: Callable[[list[str]], Iterable[Any]], most: int = 150_000):
        self.function, self.most = function, most
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        _REMEMBERING.add(self)

    def of(self, items: Sequence[str]) -> list:
        """The values (never None) of ``items``, in their order."""
        values = list(map(self.old.get, items))
        if None in values:
            missing = dict.fromkeys(x for x, v in zip(items, values) if v is None)
            for x in missing:
                missing[x] = self.young.pop(x, None)
            if len(self.old) >= self.most:
                self.old.clear()
            self.old.update((x, v) for x, v in missing.items() if v is not None)
            new = [x for x, v in missing.items() if v is None]
            if len(self.young) >= self.most:
                self.young.clear()
            for x, v in zip(new, self.function(new)):
                missing[x] = self.young[x] = v
            values = [missing[x] if v is None else v for x, v in zip(items, values)]
        return values

    def clear(self) -> int:
        held, self.young, self.old = len(self.young) + len(self.old), {}, {}
        return held


class Lookup:
    """Values of strings in one dictionary that holds at least those asked for last.

    Cheaper than ``Remembered`` for many different strings at once: what is missing is one set difference, and callers
    read the dictionary itself. With more than ``most`` strings it begins anew.
    """

    def __init__(self, function: Callable[[list[str]], Iterable[Any]], most: int):
        self.function, self.most = function, most
        self.known: dict[str, Any] = {}
        _REMEMBERING.add(self)

    def holding(self, items: set[str]) -> dict[str, Any]:
        """A dictionary with the values of all ``items``."""
        missing = list(items.difference(self.known))
        if len(self.known) + len(missing) > self.most and missing:
            self.known, missing = {}, list(items)
        self.known.update(zip(missing, self.function(missing)))
        return self.known

    def clear(self) -> int:
        held, self.known = len(self.known), {}
        return held
