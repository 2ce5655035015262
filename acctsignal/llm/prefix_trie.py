"""Prefix tries of conversations.

A conversation is a string of fixed-width turn digests, so conversations in string order have the members of each
prefix side by side. Each range of that order makes its own forest: neighbours are joined by edges as deep as their common
prefix, edges are taken from the deepest on, and every merge of two components makes, or widens, a branching node. Nodes
on the paths of a range's first and last conversation may go on in other ranges; they are contracted to one row per
depth and merged by prefix. All other nodes are final.

All that is added up over ranges is a sum over conversations or over places where a prefix starts. A range
counts a prefix as new at its first conversation, and its last conversation as a leaf; one row per border and depth takes
back what the common prefix of the conversations on both sides makes wrong.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctsignal.session import materialize

#: Characters of a turn's digest: 128 bits in hexadecimal.
DIGEST = 32
#: Ids that end at one node go to its hash in rows of at most so many.
IDS_AT_ONCE = 10_000
#: Rows handed on at once.
ROWS_AT_ONCE = 20_000


def turn_digest(role: Column, text: Column) -> Column:
    """A fixed-width digest of (role, text); the role's length keeps the two apart."""
    together = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(together.cast("binary"), 256), 1, DIGEST)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's (digest, size) in order of ``turn``, NULL first.

    NULL role or text counts as empty. Rows of one turn number are in order of their digests, repeated rows are turns of
    their own. Rows without conv_id belong to no conversation. Texts stay where they are: a turn is 44 bytes here.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_digest(role, text).alias("digest"), F.length(text).alias("size"))
    return rows.groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "digest", "size"))),
        lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def common_turns(a: str, b: str) -> int:
    """Turns that both sequences begin with."""
    if b.startswith(a):
        return len(a) // DIGEST
    low, high = 0, min(len(a), len(b)) // DIGEST  # low turns are common, the answer is below or at high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST:middle * DIGEST] == b[low * DIGEST:middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def prefix_key(sequence: str, depth: int) -> str:
    """What a prefix is called outside its range."""
    return f"{depth}-{hashlib.blake2b(sequence[:depth * DIGEST].encode(), digest_size=16).hexdigest()}"


def ids_hash(chunks: Iterator[str]) -> str:
    state = hashlib.sha256()
    for i, chunk in enumerate(chunks):
        state.update((("," if i else "") + chunk).encode())
    return state.hexdigest()


NO_IDS = ids_hash(iter(()))


class _Node:
    """A component of the forest: the node at its top, with sums over the conversations below."""

    __slots__ = ("depth", "some", "conv", "n", "children", "leaves", "saved", "ids", "below", "outer")

    def __init__(self, depth, some, conv, n, children, leaves, saved, ids=None, below=(), outer=False):
        self.depth, self.some, self.conv, self.n = depth, some, conv, n
        self.children, self.leaves, self.saved = children, leaves, saved
        self.ids, self.below, self.outer = ids, list(below), outer


class Forest:
    """The trie of consecutive conversations: distinct sequences with their turn sizes and sorted ids."""

    def __init__(self, rows: list[tuple[str, list[int], list[int]]]):
        self.rows = rows
        self.sums = [list(accumulate(sizes, initial=0)) for _, sizes, _ in rows]
        last = len(rows) - 1
        self.tops = []
        for i, (sequence, sizes, ids) in enumerate(rows):
            depth = len(sizes)
            own = (len(ids) - 1) * (sizes[-1] if sizes else 0)
            self.tops.append(_Node(depth, i, ids[0], len(ids), 0, 1, own, ids, outer=i in (0, last)))
        self.parent = list(range(len(rows)))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def chain_saved(self, node: _Node, depth: int) -> int:
        """Saved tokens of the subtree at ``depth`` on the unary path that ends in ``node``."""
        sums = self.sums[node.some]
        return node.saved + (node.n - 1) * (sums[max(node.depth - 1, 0)] - sums[max(depth - 1, 0)])

    def build(self) -> _Node:
        """Merge along all edges, the deepest first; returns the root."""
        edges = sorted(((common_turns(a[0], b[0]), i) for i, (a, b) in enumerate(zip(self.rows, self.rows[1:]))),
                       key=lambda e: (-e[0], e[1]))
        for depth, i in edges:
            a, b = self.find(i), self.find(i + 1)
            left, right = self.tops[a], self.tops[b]
            self.parent[b] = a
            if left.depth == depth:
                top, more = left, [right]
                if not left.children:
                    left.leaves = 0  # it ends here, but others go on
            else:
                top, more = _Node(depth, left.some, left.conv, 0, 0, 0, 0), [left, right]
                top.saved = -self._size(top)  # a prefix is kept once
            for node in more:
                top.below.append(node)
                top.conv = min(top.conv, node.conv)
                top.n += node.n
                top.children += 1
                top.leaves += node.leaves
                top.saved += self.chain_saved(node, depth + 1) + node.n * self._size(top)
                top.outer |= node.outer
            self.tops[a] = top
        root = self.tops[self.find(0)]
        if root.depth:
            root = _Node(0, root.some, root.conv, root.n, 1, root.leaves, self.chain_saved(root, 1), None, [root], True)
        return root

    def _size(self, node: _Node) -> int:
        return self.rows[node.some][1][node.depth - 1] if node.depth else 0

    def nodes(self) -> Iterator[tuple[_Node, int, _Node | None]]:
        """(node, first depth of the unary path above it, parent), from the root on."""
        root = self.build()
        todo: list[tuple[_Node, int, _Node | None]] = [(root, 0, None)]
        while todo:
            node, first, parent = todo.pop()
            yield node, first, parent
            todo.extend((below, node.depth + 1, node) for below in node.below)


_NUMBERS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_ROW = pa.schema([("kind", pa.string()), ("key", pa.string()), ("parent_key", pa.string()),
                  *[(c, pa.int64()) for c in _NUMBERS], ("ends_sha256", pa.string()), ("ids", pa.string()),
                  ("last_key", pa.string()), ("sizes", pa.list_(pa.int32()))])
_ROW_DDL = ("kind string, key string, parent_key string, " + ", ".join(f"{c} long" for c in _NUMBERS)
            + ", ends_sha256 string, ids string, last_key string, sizes array<int>")


def _row(kind: str, **values) -> dict:
    return {**dict.fromkeys(_ROW.names), "kind": kind, **values}


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_AT_ONCE:
            yield pa.RecordBatch.from_pylist(held, _ROW)
            held = []
    yield pa.RecordBatch.from_pylist(held, _ROW)


def _forest_rows(forest: Forest) -> Iterator[dict]:
    """Final nodes, nodes to be merged (``open``), the ids that end at those (``ids``), the range's ends (``border``)."""
    rows = forest.rows
    for node, first, parent in forest.nodes():
        sequence = rows[node.some][0]
        for depth in range(first, node.depth + 1):
            bottom = depth == node.depth
            ids = node.ids if bottom and node.ids else ()
            values = {"conv_id": node.conv, "depth": depth, "n_convs": node.n, "n_leaves": node.leaves,
                      "n_children": node.children if bottom else 1,
                      "saved_tokens": forest.chain_saved(node, depth) if depth < node.depth else node.saved}
            if node.outer:
                key = prefix_key(sequence, depth)
                yield _row("open", key=key, parent_key=prefix_key(sequence, depth - 1) if depth else None, **values)
                for i in range(0, len(ids), IDS_AT_ONCE):
                    part = ids[i:i + IDS_AT_ONCE]
                    yield _row("ids", key=key, conv_id=part[0], ids=",".join(map(str, part)))
            else:
                values["ends_sha256"] = ids_hash(iter([",".join(map(str, ids))])) if ids else NO_IDS
                if depth > first or not parent.outer:
                    yield _row("final", parent_conv_id=node.conv if depth > first else parent.conv, **values)
                else:
                    yield _row("final", parent_key=prefix_key(sequence, depth - 1), **values)
    yield _row("border", key=rows[0][0], conv_id=rows[0][2][0], last_key=rows[-1][0], sizes=rows[0][1])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of a task's sorted conversations."""
    rows: list[tuple[str, list[int], list[int]]] = []
    for batch in batches:
        for conv, sequence, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[-1][0] == sequence:
                rows[-1][2].append(conv)
            else:
                rows.append((sequence, sizes, [conv]))
    if rows:
        yield from _batches(_forest_rows(Forest(rows)))


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each border between ranges, what its common prefix was counted twice for."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for line in batch.to_pylist():
                sequence, sizes = line["key"], line["sizes"]
                common = common_turns(line["before"], sequence)
                sums = list(accumulate(sizes, initial=0))
                ended = common == len(line["before"]) // DIGEST
                for depth in range(common + 1):
                    yield _row("open", key=prefix_key(sequence, depth), depth=depth, n_convs=0,
                               n_children=-1 if depth < common else 0, n_leaves=-1 if ended else 0,
                               saved_tokens=sums[common] - sums[max(depth - 1, 0)])

    yield from _batches(rows())


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node of its ids, which come in ascending parts."""
    key, state, found = None, None, []
    for batch in batches:
        for name, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if name != key:
                if key is not None:
                    found.append((key, state.hexdigest()))
                key, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(("," + ids).encode())
    if key is not None:
        found.append((key, state.hexdigest()))
    keys, hashes = zip(*found) if found else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of ``conversations`` (conv_id: long, unique; turns: array of digest and size).

    A row per distinct prefix: ``conv_id``, its smallest member; ``depth``; ``parent_conv_id`` (root: NULL); ``n_convs``,
    members; ``n_children``; ``n_leaves``, childless nodes at or below it; ``saved_tokens``, (members - 1) times the size of the
    last turn, summed over the nodes at or below it; ``ends_sha256`` of the sorted ids of members that end here,
    joined by commas. A conversation without turns ends at the root. No conversations, no rows.

    Equal conversations are dealt out by id, so a group of them may be in many ranges. A task holds its range's
    conversations as digests; one conversation of a million turns is 32 MB.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("sequence"),
        F.transform("turns", lambda t: t["size"].cast("int")).alias("sizes"))
    ordered = rows.repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    found = materialize(ordered.mapInArrow(_forests, _ROW_DDL), "forests")

    along = Window.orderBy("key", "conv_id")
    borders = found.where("kind = 'border'").select("key", "sizes", F.lag("last_key").over(along).alias("before"))
    corrections = borders.where("before is not null").mapInArrow(_corrections, _ROW_DDL)
    parts = found.where("kind = 'open'").unionByName(corrections)
    merged = parts.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    ends = (found.where("kind = 'ids'").select("key", "conv_id", "ids").repartition("key")
            .sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(_ends, "key string, ends_sha256 string"))
    outer = materialize(merged.join(ends, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS))), "outer-nodes")

    columns = ["conv_id", "depth", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    final = found.where("kind = 'final'")
    parents = outer.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    below = final.where("parent_key is not null").select(columns).unionByName(outer.select(columns))
    joined = below.join(parents, "parent_key", "left").select(*_NUMBERS, "ends_sha256")
    return final.where("parent_key is null").select(*_NUMBERS, "ends_sha256").unionByName(joined)


def branched(conversations: DataFrame, every: int, most: int) -> DataFrame:
    """Conversations that begin like others, rebuilt from ``sequences``: (conv_id, turns).

    Conversation c gets the first h turns of conversation c - c % every (all if fewer, none if there is no such
    conversation) in place of its own first h; h is crc32 of the decimal c, modulo ``most``.
    """
    own = conversations.withColumns({
        "_from": F.col("conv_id") - F.col("conv_id") % every,
        "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})
    begins = conversations.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_from"), F.slice("turns", 1, most).alias("_begin"))
    rest = F.when(F.size("turns") > F.col("_h"), F.slice("turns", F.col("_h") + 1, F.size("turns"))).otherwise(
        F.slice("turns", 1, 0))
    begin = F.coalesce(F.slice("_begin", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    return own.join(begins, "_from", "left").select("conv_id", F.concat(begin, rest).alias("turns"))
