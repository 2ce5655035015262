"""Byte-level BPE: encoding with a pair occurrence index, and decoding.

New pieces of text are encoded together. An index maps each pair of neighbouring symbols that can be merged, by its rank, to
the list of all places where it stands in any of the pieces. The ranks that have places are active: the lowest is
taken, merged at all its places, and the lists of the pairs that arise beside them are extended, until no rank is active.
Places whose pair has gone since are passed over.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from acctsignal.llm.batches import Lookup, in_chunks, unused_name

#: Fixed value: how the byte-level vocabulary cuts a text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Below this character the expression's classes are the library's; other texts are cut by the library itself.
_SAME_CLASSES = "\u0250"
_MARKS = frozenset(".,;:!?")
#: A rank with so many places is merged at all of them in array operations, else one by one.
MANY_PLACES = 24
#: Rank of two symbols that are not merged.
NO_RANK = np.int32(2**31 - 1)
#: Characters whose units are looked up together.
_CHARS_AT_ONCE = 8_000_000
#: Characters other than space and line feed that may count as white space.
_RARE_SPACE = [c for c in map(chr, range(0x3001)) if c not in " \n" and c.isspace()]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class ByteBpe:
    """A vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary = described["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.of_byte = [vocabulary[c] for c in byte_symbols()]
        self.rank_of: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(described["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_of[vocabulary[left] << 32 | vocabulary[right]] = rank
            self.merges.append((vocabulary[left], vocabulary[right], vocabulary[left + right]))
        order = sorted(self.rank_of)
        self.sorted_pairs = np.array(order, np.int64)
        self.sorted_ranks = np.array([self.rank_of[pair] for pair in order], np.int32)
        self.merged = np.array([merged for _, _, merged in self.merges], np.int32)
        self.symbol_of_byte = np.array(self.of_byte, np.int32)
        self.pieces = Lookup(self.merge_all, 300_000)
        self.units = Lookup(self.encode_units, 500_000)
        self.first_units = Lookup(lambda texts: self.encode_units(texts, ""), 50_000)
        size = max(self.bytes_of) + 1
        tokens = [self.bytes_of.get(i, b"") for i in range(size)]
        self.token_sizes = np.fromiter(map(len, tokens), np.int64, size)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.library = Tokenizer.from_file(path).pre_tokenizer

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NO_RANK if they are not merged."""
        pairs = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.sorted_pairs, pairs)
        at[at == len(self.sorted_pairs)] = 0
        return np.where(self.sorted_pairs[at] == pairs, self.sorted_ranks[at], NO_RANK)

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as 32-bit numbers.

        The symbols of all pieces are one linked list with gaps between pieces; a merge costs what it changes.
        """
        if not pieces:
            return []
        encoded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ends = np.cumsum(sizes + 1)  # a gap lies before the first piece and behind each
        symbols = np.full(int(ends[-1]) + 1, -1, np.int32)
        inside = np.ones(len(symbols), bool)
        inside[0] = inside[ends] = False
        symbols[inside] = self.symbol_of_byte[np.frombuffer(b"".join(encoded), np.uint8)]
        after = np.arange(1, len(symbols) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbols) - 1, dtype=np.int32)
        places: dict[int, list[int]] = {}
        active: list[int] = []

        def index(at: np.ndarray, right: np.ndarray) -> None:
            """Add the places ``at``, whose pair's second symbol stands at ``right``, to the lists of their ranks."""
            both = (symbols[at] >= 0) & (symbols[right] >= 0)
            at, found = at[both], self.ranks(symbols[at[both]], symbols[right[both]])
            order = np.argsort(found, kind="stable")
            order = order[:np.searchsorted(found[order], NO_RANK)]
            at, found = at[order], found[order]
            if not len(at):
                return
            cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(at)]
            listed = at.tolist()
            for rank, a, b in zip(found[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if rank in places:
                    places[rank] += listed[a:b]
                else:
                    places[rank] = listed[a:b]
                    heapq.heappush(active, rank)

        everywhere = np.arange(len(symbols) - 1)
        index(everywhere, everywhere + 1)
        one, next_one, last_one = memoryview(symbols), memoryview(after), memoryview(before)
        rank_of, merges = self.rank_of, self.merges
        while active:
            rank = heapq.heappop(active)
            left, right, merged = merges[rank]
            listed = places.pop(rank)
            if len(listed) >= MANY_PLACES and left != right:
                at = np.array(listed, np.int64)
                then = after[at]
                there = (symbols[at] == left) & (symbols[then] == right)
                at, then = at[there], then[there]
                symbols[at], symbols[then] = merged, -2
                last = after[then]
                after[at], before[last] = last, at
                first = before[at]
                index(np.concatenate((first, at)), np.concatenate((at, last)))
                continue
            for at in sorted(listed):
                then = next_one[at]
                if one[at] != left or one[then] != right:
                    continue  # another place of this or of a lower rank has taken one of them
                one[at], one[then] = merged, -2
                last = next_one[then]
                next_one[at], last_one[last] = last, at
                for place in (last_one[at], at):
                    a, b = one[place], one[next_one[place]]
                    if a >= 0 and b >= 0 and (new := rank_of.get(a << 32 | b)) is not None:
                        if new in places:
                            places[new].append(place)
                        else:
                            places[new] = [place]
                            heapq.heappush(active, new)
        kept = symbols >= 0
        flat, until = symbols[kept].tobytes(), (4 * np.cumsum(kept)[ends]).tolist()
        return [flat[a:b] for a, b in zip([0, *until], until)]

    def cut_plain(self, text: str) -> list[str]:
        """The pieces that a text is cut into."""
        if not text or max(text) < _SAME_CLASSES:
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode_units(self, units: list[str], lead: str = " ") -> list[bytes]:
        """Ids of texts that stand between single spaces; ``lead`` is the space before each."""
        # words, and words with a mark behind them, need no expression; a word is one piece and kept as a unit already
        is_word = [u.isalpha() and (u.isascii() or max(u) < _SAME_CLASSES) for u in units]
        words = [lead + u for u, one in zip(units, is_word) if one]
        cut = [(lead + u[:-1], u[-1]) if u[-1:] in _MARKS and u[:-1].isalpha() and (u.isascii() or max(u) < _SAME_CLASSES)
               else self.cut_plain(lead + u) for u, one in zip(units, is_word) if not one]
        ids = self.pieces.holding(set(chain.from_iterable(cut)))
        of_word, of_other = iter(self.merge_all(words)), iter([b"".join(map(ids.__getitem__, pieces)) for pieces in cut])
        return [next(of_word) if one else next(of_other) for one in is_word]

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, whatever its white space."""
        pieces = self.cut_plain(text)
        return b"".join(map(self.pieces.holding(set(pieces)).__getitem__, pieces))

    def encode_special(self, text: str) -> bytes:
        """Ids of a text in which the special tokens' strings are these tokens."""
        return b"".join(np.int32(self.special[part]).tobytes() if part in self.special else self.encode_plain(part)
                        for part in self.cut.split(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit numbers.

        A space begins a piece, but for one between two others of white space. Without such, what stands between
        single spaces is a unit of its own; the units of all texts are looked up together. Other texts are cut whole.
        """
        special = [any(s in t for s in self.special) for t in texts]
        simple = [not (s or "  " in t or "\n \n" in t or any(c in t for c in _RARE_SPACE)) for s, t in zip(special, texts)]
        units = [t.split(" ") if ok else [""] for t, ok in zip(texts, simple)]
        first_of = self.first_units.holding({u[0] for u in units})
        known = self.units.holding(set(chain.from_iterable(u[1:] for u in units)))
        return [first_of[u[0]] + b"".join(map(known.__getitem__, u[1:])) if ok else
                self.encode_special(t) if s else self.encode_plain(t)
                for u, t, s, ok in zip(units, texts, special, simple)]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' bytes one after the other, gathered from one table of all tokens."""
        sizes = self.token_sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return ""
        shift = np.repeat(self.token_starts[ids] - (ends - sizes), sizes)
        return self.token_bytes[np.arange(ends[-1]) + shift].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """Each Python worker reads a vocabulary once."""
    return ByteBpe(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array of token ids of every whole text; a null text counts as empty.

    ``path`` names the vocabulary's JSON file on every executor. A column with the name of ``ids`` is replaced.
    """
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        model, encoded = byte_bpe(path), []
        for _, chunk in in_chunks([t or "" for t in texts.to_pylist()], _CHARS_AT_ONCE):
            encoded += model.encode(chunk)
        offsets = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(encoded), np.int32))

    return docs.withColumn(ids, encode(F.col(text)))


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of each array of token ids, special tokens included; null ids give a null text."""
    @F.arrow_udf("string")
    def decode(arrays: pa.Array) -> pa.Array:
        model = byte_bpe(path)
        return pa.array([None if a.values is None else model.decode(a.values.to_numpy()) for a in arrays], pa.string())

    return docs.withColumn(text, decode(F.col(ids)))
