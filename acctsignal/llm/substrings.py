"""Removal of passages that documents with smaller ids have too.

Every window of so many words has a Rabin-Karp hash: words are polynomials of their bytes, windows polynomials of
their words, both as differences of running sums. Spark counts the windows in two rounds. In the first, each block of
documents sends four bytes of each of its windows' hashes to the hash's range, which says which ones other
blocks have too. In the second, only those go again, with 128 bits and the smallest id that has them in the block. A range
answers one bit per window: whether a smaller id has it elsewhere.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctsignal.llm.batches import mix64
from acctsignal.session import materialize

#: UTF-8 bytes of the documents that are hashed together; a longer text is a block of its own.
BLOCK_BYTES = 4_000_000
#: UTF-8 bytes of all documents for each range of hashes, so that a range's hashes fit a task at any size.
RANGE_BYTES = 16_000_000
#: Bytes whose words are hashed at once.
SLAB_BYTES = 1 << 20
#: Odd multipliers of the polynomials over bytes and over words, one pair per hash.
BASES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


@functools.lru_cache(maxsize=16)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ``base`` and of its inverse, modulo 2^64."""
    of = [np.full(size, x, dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for powers in of:
        powers[:1] = 1
        np.multiply.accumulate(powers, out=powers)
    return of[0], of[1]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hashes of values[start:end], values counted from 1 so that leading zeros matter."""
    size = 1 << max(10, int(len(values) - 1).bit_length())
    powers, inverse = _powers(base, size)
    running = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values + np.uint64(1)) * powers[:len(values)], out=running[1:])
    return mix64((running[ends] - running[starts]) * inverse[starts])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: longest stretches without ASCII white space."""
    inside = np.concatenate(([False], ~_WHITE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the words, a slab of words at a time."""
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLAB_BYTES, side="right")))
        low = starts[first]
        hashes[first:last] = _spans(data[low:ends[last - 1]].astype(np.uint64), starts[first:last] - low,
                                    ends[first:last] - low, base)
        first = last
    return hashes


class Block:
    """The windows of a few documents: where each starts, the id of its document, its hashes."""

    def __init__(self, ids: list, texts: list[str], window: int):
        self.ids, self.texts, self.window = ids, texts, window
        # white space between texts keeps their words apart
        encoded = [text.encode() for text in texts]
        self.data = np.frombuffer(b" ".join(encoded), dtype=np.uint8)
        self.starts, self.ends = word_bounds(self.data)
        begin = np.cumsum([0, *[len(e) + 1 for e in encoded]])
        self.bounds = np.searchsorted(self.starts, begin)
        # a document without id has no windows: it is neither smaller nor larger than another
        at = [np.arange(a, b - window + 1) for i, a, b in zip(ids, self.bounds, self.bounds[1:])
              if i is not None and b - a >= window]
        self.at = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
        counts = [max(0, b - a - window + 1) if i is not None else 0
                  for i, a, b in zip(ids, self.bounds, self.bounds[1:])]
        self.owner = np.repeat(np.array([i or 0 for i in ids], dtype=np.int64), counts)

    def hashes(self, which: int, at: np.ndarray) -> np.ndarray:
        """A hash of each window that starts at the words ``at``."""
        byte_base, word_base = BASES[which]
        words = _word_hashes(self.data, self.starts, self.ends, byte_base)
        return _spans(words, at, at + self.window, word_base)


def _codes(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """A hash's range above four bytes of the hash."""
    return ((hashes >> np.uint64(32)) % np.uint64(ranges)) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _by_range(numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(range, its stretch) of sorted range numbers."""
    if len(numbers):
        cuts = np.concatenate(([0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, [len(numbers)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(numbers[a]), slice(int(a), int(b))


def _flags(answers: pa.Table, numbers: np.ndarray) -> np.ndarray:
    """The bits that the ranges answered, for windows in the order of their (sorted) range numbers."""
    packed = dict(zip(answers.column("range").to_pylist(), answers.column("flags").to_pylist()))
    found = np.zeros(len(numbers), dtype=bool)
    for number, part in _by_range(numbers):
        if number in packed:
            bits = np.unpackbits(np.frombuffer(packed[number], dtype=np.uint8))
            found[part] = bits[:part.stop - part.start].astype(bool)
    return found


_SENT = "range long, block long, hashes binary"
_ANSWER = "block long, range long, flags binary"


def _sent(block: int, parts: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"range": pa.array([r for r, _ in parts], pa.int64()),
                     "block": pa.array([block] * len(parts), pa.int64()),
                     "hashes": pa.array([b for _, b in parts], pa.binary())})


def _answer(group: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    """One row per block that has a bit set."""
    rows = [(b, r, np.packbits(f).tobytes())
            for b, r, f in zip(group.column("block").to_pylist(), group.column("range").to_pylist(), flags) if f.any()]
    blocks, ranges, bits = zip(*rows) if rows else ((), (), ())
    return pa.table({"block": pa.array(blocks, pa.int64()), "range": pa.array(ranges, pa.int64()),
                     "flags": pa.array(bits, pa.binary())})


def _block(docs: pa.Table, window: int) -> Block:
    docs = docs.sort_by("place")
    return Block(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), window)


def _first_send(window: int, ranges: int):
    def send(docs: pa.Table) -> pa.Table:
        block = _block(docs, window)
        codes = np.unique(_codes(block.hashes(0, block.at), ranges))
        parts = [(r, codes[part].astype(np.uint32).tobytes()) for r, part in _by_range(codes >> np.uint64(32))]
        return _sent(docs.column("block")[0].as_py(), parts)
    return send


def _met_twice(group: pa.Table) -> pa.Table:
    """Of a range's hashes, each block's once: which of them have more than one block."""
    sent = [np.frombuffer(x, dtype=np.uint32) for x in group.column("hashes").to_pylist()]
    everything = np.sort(np.concatenate(sent))
    twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
    return _answer(group, [np.isin(hashes, twice, assume_unique=True) for hashes in sent])


class _Candidates:
    """A block's windows that may have equals elsewhere or in the block: the different ones with their smallest id."""

    def __init__(self, block: Block, answers: pa.Table, ranges: int):
        first = block.hashes(0, block.at)
        codes = _codes(first, ranges)
        different, which, times = np.unique(codes, return_inverse=True, return_counts=True)
        maybe = _flags(answers, different >> np.uint64(32)) | (times > 1)
        self.chosen = np.flatnonzero(maybe[which])
        first = first[self.chosen]
        second = block.hashes(1, block.at[self.chosen])
        owner = block.owner[self.chosen]
        numbers = (first >> np.uint64(32)) % np.uint64(ranges)
        order = np.lexsort((owner, second, first, numbers))
        a, b, r = first[order], second[order], numbers[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.owner = owner
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.ranges, self.first, self.second, self.smallest = r[new], a[new], b[new], owner[order][new]

    def removable(self, answers: pa.Table) -> np.ndarray:
        """For each chosen window, whether a smaller id has it too."""
        return _flags(answers, self.ranges)[self.group] | (self.smallest[self.group] < self.owner)


def _second_send(window: int, ranges: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _sent(0, [])
        found = _Candidates(_block(docs, window), answers, ranges)
        parts = [(r, b"".join(x[part].tobytes() for x in (found.first, found.second, found.smallest)))
                 for r, part in _by_range(found.ranges)]
        return _sent(docs.column("block")[0].as_py(), parts)
    return send


def _smaller_elsewhere(group: pa.Table) -> pa.Table:
    """Of a range's hashes with each block's smallest id: which have a smaller id in another block."""
    sent = [np.frombuffer(x, dtype=np.uint64).reshape(3, -1) for x in group.column("hashes").to_pylist()]
    sizes = [x.shape[1] for x in sent]
    first, second, ids = np.concatenate(sent, axis=1)
    ids = ids.view(np.int64)
    order = np.lexsort((ids, second, first))
    a, b, i = first[order], second[order], ids[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    smaller = np.empty(len(order), dtype=bool)
    smaller[order] = i[new][np.cumsum(new) - 1] < i
    return _answer(group, np.split(smaller, np.cumsum(sizes)[:-1]))


def covered(starts: np.ndarray, window: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window that starts at one of ``starts``."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, size), -1)
    return np.cumsum(change)[:size] > 0


_RESULT = "doc_id long, n_words long, removed array<struct<start: long, stop: long>>, kept string"


def _remove(window: int, ranges: int):
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def remove(docs: pa.Table, first: pa.Table, second: pa.Table) -> pa.Table:
        block = _block(docs, window)
        found = _Candidates(block, first, ranges)
        starts = block.at[found.chosen][found.removable(second)]
        gone = covered(starts, window, len(block.starts))
        removed, kept = [], []
        for text, a, b in zip(block.texts, block.bounds, block.bounds[1:]):
            words, flags = text.encode().split(), gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
            removed.append([{"start": int(x), "stop": int(y)} for x, y in zip(edges[0::2], edges[1::2])])
            kept.append(b" ".join(w for w, f in zip(words, flags.tolist()) if not f) if len(edges) else b" ".join(words))
        return pa.table({
            "doc_id": pa.array(block.ids, pa.int64()), "n_words": pa.array(np.diff(block.bounds), pa.int64()),
            "removed": pa.array(removed, pa.list_(span)), "kept": pa.array([k.decode() for k in kept], pa.string())})

    def both(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                             "removed": pa.array([], pa.list_(span)), "kept": pa.array([], pa.string())})
        is_first = pc.equal(answers.column("round"), 1)
        return remove(docs, answers.filter(is_first), answers.filter(pc.invert(is_first)))
    return both


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their block and their place."""
    before, place, high = 0, 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = before + np.cumsum(sizes) - sizes
        before += int(sizes.sum())
        places = np.arange(place, place + batch.num_rows)
        place += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(high + begin // BLOCK_BYTES), pa.array(places), batch.column("doc_id"), batch.column("text")],
            ["block", "place", "doc_id", "text"])


def remove_repeated(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, removed, kept``: every document without the words that a smaller id's window covers.

    A window is ``window`` consecutive words (stretches without ASCII white space) of one document. ``removed`` has the
    maximal intervals of words, ``kept`` the other words with single spaces. Windows are judged on the input.

    A NULL text counts as empty. A document without id removes nothing and loses nothing. Rows that repeat an id are
    documents of that id: they do not remove from each other. Other columns are not read.

    A block's windows go once each to a range, however often it has them, so a passage that all documents share is as
    many hashes in its range as there are blocks. Ranges grow in number with the documents.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = materialize(rows.mapInArrow(_numbered, "block long, place long, doc_id long, text string"), "blocks")
    size = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2 * tasks, size // RANGE_BYTES)
    grouped = blocks.groupBy("block")
    first = materialize(
        grouped.applyInArrow(_first_send(window, ranges), _SENT).groupBy("range").applyInArrow(_met_twice, _ANSWER),
        "met-twice")
    second = materialize(
        grouped.cogroup(first.groupBy("block")).applyInArrow(_second_send(window, ranges), _SENT)
        .groupBy("range").applyInArrow(_smaller_elsewhere, _ANSWER), "smaller-elsewhere")
    answers = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return grouped.cogroup(answers.groupBy("block")).applyInArrow(_remove(window, ranges), _RESULT)
