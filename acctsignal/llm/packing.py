"""Packing of tokenized documents into sequences of one length by minimum bin slack.

A block of documents is packed at a time, inside the task that has read it, so nothing is shuffled. A document longer
than a sequence fills whole sequences first. A sequence then takes the longest rest that is left and those of the other
rests whose lengths add up closest to what is missing: a subset sum over a bit set, from which the counts of
each length are traced back. What is still missing is cut off the longest rest. The last rests of a block are cut into
sequences whose lengths are powers of two, so no sequence is padded.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from acctsignal.llm.batches import Lookup, forget, in_chunks
from acctsignal.llm.byte_bpe import byte_symbols

#: Tokens packed together.
BLOCK_TOKENS = 1_000_000
#: Characters whose words are looked up together.
_CHARS_AT_ONCE = 8_000_000
#: Fixed value: how the vocabulary cuts a word, after it is lowered, into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Below this, lowering and normalising a word leaves no choice: no combining marks, no final forms.
_LATIN_END = "\u0250"
#: Control characters on which Python splits, though they aren't white space everywhere.
_UNSURE = "\x1c\x1d\x1e\x1f\x85"


def best_counts(counts: Mapping[int, int], room: int, lengths: list[int] | None = None) -> dict[int, int]:
    """How many of each length to take so that the sum comes closest to ``room`` without passing it.

    ``reached`` has bit s set if lengths seen so far can add up to s. Multiples 1, 2, 4, … of each length are offered,
    the longest first, until ``room`` is reached; the sums are traced back through the sets before each offer.
    ``lengths`` are the keys of ``counts``, sorted.
    """
    lengths = sorted(counts) if lengths is None else lengths
    reached, offers, full, most = 1, [], 1 << room, (1 << (room + 1)) - 1
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[at]
        left, times = min(counts[length], room // length), 1
        while left and not reached & full:
            times = min(times, left)
            offers.append((length, times, reached))
            reached |= (reached << (length * times)) & most
            left -= times
            times *= 2
        if reached & full:
            break
    total, taken = reached.bit_length() - 1, {}
    for length, times, before in reversed(offers):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + times
            total -= length * times
    return taken


def pack_block(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); every token of every document lies in exactly one."""
    sequences, rests = [], {}
    for doc, tokens in enumerate(lengths):
        whole = tokens // capacity
        sequences += [[(doc, k * capacity, capacity)] for k in range(whole)]
        if tokens % capacity:
            rests.setdefault(tokens % capacity, []).append((doc, whole * capacity))

    counts = {n: len(r) for n, r in rests.items()}
    left = sorted(rests)  # the lengths that are left

    def take(length: int) -> tuple[int, int]:
        found = rests[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del rests[length], counts[length], left[bisect_left(left, length)]
        return found

    total = sum(n * times for n, times in counts.items())
    while total >= capacity:
        longest = left[-1]
        sequence = [(*take(longest), longest)]
        for length, times in best_counts(counts, capacity - longest, left).items():
            sequence += [(*take(length), length) for _ in range(times)]
        missing = capacity - sum(p[2] for p in sequence)
        if missing:
            longest = left[-1]  # longer than what is missing, or it had been taken
            doc, start = take(longest)
            sequence.append((doc, start, missing))
            if longest - missing not in rests:
                rests[longest - missing], counts[longest - missing] = [], 0
                insort(left, longest - missing)
            rests[longest - missing].append((doc, start + missing))
            counts[longest - missing] += 1
        sequences.append(sequence)
        total -= capacity
    pieces = [(doc, start, n) for n, r in sorted(rests.items(), reverse=True) for doc, start in r]
    while total:
        room = 1 << (total.bit_length() - 1)
        total, sequence = total - room, []
        while room:
            doc, start, n = pieces.pop(0)
            part = min(n, room)
            sequence.append((doc, start, part))
            if part < n:
                pieces.insert(0, (doc, start + part, n - part))
            room -= part
        sequences.append(sequence)
    return sequences


class WordTokens:
    """Ids of a tokenizer that drops white space, looked up by word; new words go through the tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.symbols = dict(enumerate(byte_symbols()))
        self.pieces = Lookup(self.encode_pieces, 400_000)
        self.words = Lookup(self.encode_words, 600_000)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. Lowered Latin pieces are words of the tokenizer's model as they are, but for the symbols that
        stand for their bytes; others go through the whole tokenizer."""
        odd = [p for p in pieces if not (p.isascii() or max(p) < _LATIN_END)]
        known = dict(zip(odd, self.encode(odd))) if odd else {}
        tokenize, symbols = self.tokenizer.model.tokenize, self.symbols
        return [known[p] if p in known else array("I", [t.id for t in tokenize(
            p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(symbols))]).tobytes() for p in pieces]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space; those of Latin letters are put together from their pieces' ids."""
        cut = []
        for w in words:
            low = w.lower()  # may hold a mark that is no letter, which then belongs to the punctuation behind it
            if not (w.isascii() or max(w) < _LATIN_END):
                cut.append((w,))
            elif low.isalpha():
                cut.append((low,))
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                cut.append((low[:-1], low[-1]))
            else:
                cut.append(PIECES.findall(low))
        ids = self.pieces.holding(set(chain.from_iterable(cut)))
        return [ids[pieces[0]] if len(pieces) == 1 else b"".join(map(ids.__getitem__, pieces)) for pieces in cut]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        plain = [not any(s in t for s in self.special) and not any(c in t for c in _UNSURE) for t in texts]
        words = [t.split() if ok else [] for t, ok in zip(texts, plain)]
        known = self.words.holding(set().union(*words))
        return [b"".join(map(known.__getitem__, w)) if ok else self.encode([t])[0]
                for w, t, ok in zip(words, texts, plain)]


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    """Each Python worker reads a tokenizer once."""
    return WordTokens(path)


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", *, capacity: int = 4096,
                   end_id: int = 2) -> DataFrame:
    """Pieces of tokenized documents and their places in sequences of ``capacity`` tokens.

    Columns: ``doc_id``, ``start`` (the document's ids before the piece), ``length``, ``ids`` (the piece's
    little-endian unsigned 32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset``. Every document's ids end with
    ``end_id``; a null or empty text has this id alone. ``path`` names the tokenizer's file on every executor.
    A sequence's number has the number of the task's partition in its upper bits. Repeated rows are packed as they
    come; no row gives no piece.
    """
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        forget(tokens.pieces, tokens.words)
        number = TaskContext.get().partitionId() << 36
        block, size = [], 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[], [], [], [], [], [], []]
            for sequence in pack_block([len(ids) // 4 for _, ids in block], capacity):
                offset = 0
                for doc, start, length in sequence:
                    doc_id, ids = block[doc]
                    for column, value in zip(columns, (doc_id, start, length, ids[4 * start:4 * (start + length)],
                                                       len(ids) // 4, number, offset)):
                        column.append(value)
                    offset += length
                number += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, chunk in in_chunks([t or "" for t in batch.column(1).to_pylist()], _CHARS_AT_ONCE):
                for doc_id, encoded in zip(ids[first:first + len(chunk)], tokens.ids(chunk)):
                    block.append((doc_id, encoded + end))
                    size += len(encoded) // 4 + 1
                if size >= BLOCK_TOKENS:
                    yield packed()
                    block, size = [], 0
        if block:
            yield packed()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
