"""Fingerprints of documents as Merkle trees over sections, paragraphs and the sentences of a paragraph.

A leaf is a stretch of a paragraph, a paragraph's hash covers its leaves, a section's its paragraphs, the root all
sections. Equal roots mean equal texts; from different roots a comparison goes down only where hashes differ, and so
comes to the stretches that were edited.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acctsignal.session import materialize

#: A leaf ends at the first sentence end from here on …
LEAF_CHARS = 80
#: … and at the first white space from here on, or at this many characters more.
LONG_LEAF_CHARS = 400
#: A section ends after an empty line, or after a paragraph whose hash is a multiple of this.
SECTION_PARAGRAPHS = 8
_PARAGRAPH = re.compile(r"[^\n]*\n+|[^\n]+")
_LEAF = re.compile(rf".{{{LEAF_CHARS},{LONG_LEAF_CHARS}}}?(?:[.!?]\s+|$)|.{{{LONG_LEAF_CHARS}}}\S{{0,{LONG_LEAF_CHARS}}}\s*|.+", re.S)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass(frozen=True)
class Node:
    """A hash, the characters below it, and the nodes below it (none for a leaf)."""

    digest: bytes
    chars: int
    parts: tuple[Node, ...] = ()


def _above(kind: bytes, parts: list[Node]) -> Node:
    return Node(_digest(kind + b"".join(p.digest for p in parts)), sum(p.chars for p in parts), tuple(parts))


def merkle_tree(text: str) -> Node:
    """The tree of a whole text; an empty text has a root without parts."""
    sections: list[Node] = []
    open_section: list[Node] = []
    for paragraph in _PARAGRAPH.findall(text):
        node = _above(b"p", [Node(_digest(x.encode("utf-8", "surrogatepass")), len(x)) for x in _LEAF.findall(paragraph)])
        open_section.append(node)
        if paragraph.endswith("\n\n") or node.digest[0] % SECTION_PARAGRAPHS == 0:
            sections.append(_above(b"s", open_section))
            open_section = []
    if open_section:
        sections.append(_above(b"s", open_section))
    return _above(b"d", sections)


def leaves(node: Node) -> Iterator[Node]:
    if node.parts:
        for part in node.parts:
            yield from leaves(part)
    elif node.chars:
        yield node


def first_edit(a: Node, b: Node) -> int:
    """Characters before the first differing leaf of ``a``, found by going down the first differing branch; -1 if equal."""
    if a.digest == b.digest:
        return -1
    before = 0
    for x, y in zip(a.parts, b.parts):
        if x.digest != y.digest:
            return before + first_edit(x, y)
        before += x.chars
    return before


def as_text(tree: Node) -> str:
    """A fingerprint: the root in hexadecimal, then each section's shortened hash with its leaves' hashes and sizes."""
    return ":".join([tree.digest.hex(), *(
        ",".join([s.digest[:4].hex(), *(f"{leaf.digest[:4].hex()}.{leaf.chars}" for leaf in leaves(s))]) for s in tree.parts)])


def _leaves_of(sections: Counter) -> Counter:
    """How often the sections have each leaf, by hash and size."""
    found: Counter = Counter()
    for section, times in sections.items():
        for leaf in section.split(",")[1:]:
            found[leaf] += times
    return found


def _chars(of: Counter) -> int:
    return sum(int(leaf.rpartition(".")[2]) * times for leaf, times in of.items())


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are: the share of the longer text's characters in branches or leaves of both; 1 for equal roots.

    Leaves are only compared below sections that differ.
    """
    (root_a, *of_a), (root_b, *of_b) = a.split(":"), b.split(":")
    if root_a == root_b:
        return 1.0
    of_a, of_b = Counter(of_a), Counter(of_b)
    same = of_a & of_b
    common = _chars(_leaves_of(same))
    left_a, left_b = _leaves_of(of_a - same), _leaves_of(of_b - same)
    longer = max(_chars(left_a), _chars(left_b)) + common
    return (common + _chars(left_a & left_b)) / max(longer, 1)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many characters (or all) from the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, first_edit long, n_sections int, n_leaves int")
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


class _Columns:
    """Result rows on their way to a record batch; ``extra`` columns are last."""

    def __init__(self, extra: tuple[str, ...] = ()):
        self.names = [*_NAMES, *extra]
        self.kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
                      pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()][:len(self.names)]
        self.rows: list[tuple] = []

    def compare(self, doc_id: int | None, text: str, tree: Node, following: str, following_tree: Node) -> None:
        edited = edited_text(text, following)
        edited_tree = merkle_tree(edited)
        own, changed = as_text(tree), as_text(edited_tree)
        row = (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed,
               likeness(own, changed), likeness(own, as_text(following_tree)),
               first_edit(tree, edited_tree), len(tree.parts), sum(1 for _ in leaves(tree)))
        self.rows.append(row + (None,) * (len(self.names) - len(row)))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.kinds)], self.names)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document but the task's last against the next; the last comes with the first text, for the task before."""
    number, out = TaskContext.get().partitionId(), _Columns(("part", "last_text", "first_text"))
    first = last = None
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            now = doc_id, text, merkle_tree(text)
            if last is None:
                first = text
            else:
                out.compare(*last, *now[1:])
            last = now
            if len(out.rows) >= 1000:
                yield out.batch()
    if last is not None:
        out.rows.append((last[0], *[None] * (len(_NAMES) - 1), number, last[1], first))
    yield out.batch()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Columns()
    for batch in batches:
        for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
            out.compare(doc_id, text, merkle_tree(text), following, merkle_tree(following))
    yield out.batch()


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text (see ``edited_text``), and how alike they are.

    The next document is the one with the next larger id, after the last the first (a single row follows itself).
    Rows that repeat an id are ordered by text, null ids come first, a null text counts as empty. ``first_edit`` is
    the number of characters before the first edited leaf, -1 if the edit changed nothing.

    Texts are dealt out once by ranges of ids and compared in order. The two ends of each range are joined to their
    neighbours afterwards: one row per range.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    all_rows = materialize(ordered.mapInArrow(_in_order, f"{_RESULT}, part long, last_text string, first_text string"),
                           "fingerprints")
    ends = all_rows.where("part is not null").select("doc_id", "part", "last_text", "first_text")
    parts = ends.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")),
                                           F.min("part").over(Window.partitionBy())).alias("next_part"))
    following = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"))
    closing = (ends.join(parts, "part").join(following, "next_part").select("doc_id", "last_text", "next_text")
               .mapInArrow(_ends, _RESULT))
    return all_rows.where("part is null").select(*_NAMES).union(closing)
