"""Near-duplicate join on word shingles by parity sketches.

Every shingle of a text flips one bit of a sketch, so two sketches differ in at most as many bits as the two
sets have shingles that only one of them holds. A pair that is similar enough has at most D such shingles, where D
follows from the sizes. Texts of similar size share a band; the band's sketches are cut into more than D pieces, so a
similar pair has an equal piece. Texts meet on equal pieces; what meets is tested by size, by a short sketch's
Hamming distance, and at last exactly.

Equal sets are one node from the start. Within a group that meets, nodes are first compared with one pivot only, another one
in each round; when links have joined most of a group, those pairs that lie in different components are compared that have
as many equal pieces as a similar pair cannot be without. No link is lost: a pair that is never compared is already connected
or has too few equal pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctsignal.llm.batches import forget, mix64
from acctsignal.llm.components import contract
from acctsignal.session import materialize

#: Largest size of a band is this many times its smallest.
BAND_RATIO = 1.8
#: Longs of the short sketch.
SKETCH_WORDS = 16
#: Ids of candidate texts are broadcast up to this many (16 bytes each), else joined by a shuffle.
MOST_BROADCAST = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted different hashes of ``width`` consecutive words; of all words if there are fewer; none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    value = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        value = mix64(value * _STEP + hashes[k:len(words) - width + 1 + k])
    value.sort()
    return value[np.r_[True, value[1:] != value[:-1]]]


@lru_cache(maxsize=8)
def bands(threshold: int, most: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, D) of each band; any two sizes that can be similar share one."""
    found, low = [], 1
    while low <= most:
        high = max(low * 100 // threshold, int(low * BAND_RATIO))
        found.append((low, high, 2 * high * (100 - threshold) // (100 + threshold)))
        reach = high * threshold // 100  # the largest size whose partners are all in this band
        while (reach + 1) * 100 // threshold <= high:
            reach += 1
        low = max(low, reach) + 1
    return found


def piece_keys(hashes: np.ndarray, threshold: int) -> np.ndarray:
    """Keys of the sketch's pieces in each band of the set's size."""
    return keys_and_need(hashes, threshold)[0]


def keys_and_need(hashes: np.ndarray, threshold: int) -> tuple[np.ndarray, int]:
    """Keys of the sketch's pieces in each band of the set's size, and the set's need of equal ones.

    A piece's key is the XOR of a code for each of its set bits, so shingles that flip the same bit cancel. A band has
    D + 1 pieces and some to spare. A set of n shingles differs from similar sets that are not smaller in at most
    n * (100 - threshold) / threshold shingles, so its first so many pieces, one more and the spare ones will do: of
    two similar sets the smaller one's pieces are among the larger one's. Pieces without a set bit are left out unless
    there are more of them than spare ones: two similar sets agree in a piece that is not empty, or both keep their
    empty ones.

    Of the smaller set's pieces, one and the spare ones at least are equal, if the sets are similar. Those that are
    empty in both are no common keys if one of the sets leaves them out, and they are at most as many as it leaves out.
    So similar sets have at least as many common keys as the lesser of their needs.
    """
    keys, needs = [], []
    for k, (low, high, most) in enumerate(bands(threshold)):
        if low > len(hashes):
            break
        if high < len(hashes):
            continue
        spare = (most + 1) // 8
        pieces = most + 1 + spare
        sent = min(pieces, len(hashes) * (100 - threshold) // threshold + 1 + spare)
        place = mix64(hashes ^ mix64(np.array([k + 1], np.uint64)))
        piece = ((place >> _HALF) * np.uint64(pieces)) >> _HALF
        inside = piece < np.uint64(sent)
        piece, bit = piece[inside], place[inside] & _LOW
        parity = np.zeros(sent, np.uint64)
        np.bitwise_xor.at(parity, piece.astype(np.int64), mix64(bit + (piece << _HALF)))
        if np.count_nonzero(parity == 0) <= spare:
            number = np.flatnonzero(parity)
            needs.append(1 + spare - (sent - len(number)))
        else:
            needs.append(1 + spare)
            number = np.arange(sent)
        keys.append(mix64(parity[number] ^ mix64(number.astype(np.uint64) + (np.uint64(k + 1) << _HALF))))
    return (np.concatenate(keys), min(needs)) if keys else (np.zeros(0, np.uint64), 0)


def short_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each of 64 * SKETCH_WORDS bits."""
    flips = np.bincount(((hashes >> _HALF) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def set_identity(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit numbers of a set; the first names it, the second tells if two sets got one name."""
    size = np.array([len(hashes)], np.uint64)
    total = np.bitwise_xor.reduce(mix64(hashes ^ _STEP), keepdims=True) + size * _STEP
    other = np.add.reduce(mix64(hashes + np.uint64(0x5851F42D4C957F2D)), keepdims=True) ^ size
    return int(total.view(np.int64)[0]), int(other.view(np.int64)[0])


_ROWS = "doc_id long, text_key long, n long, node long, other long, need long, keys array<long>, sketch array<long>"


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[list[list]]:
    """The columns of few rows at a time, so that a worker's memory does not follow the Arrow batch."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield [column.to_pylist() for column in batch.slice(first, rows).columns]


def _sketched(width: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[int] = set()  # sets whose pieces this task has sent, so that copies send them once
        for columns in _parts(batches):
            out: list[list] = [[] for _ in range(8)]
            size = 0
            for doc_id, text, text_key in zip(*columns):
                hashes = shingle_hashes(text, width)
                node, other = set_identity(hashes) if len(hashes) else (None, None)
                need = keys = sketch = None
                if node is not None and node not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(node)
                    keys, need = keys_and_need(hashes, threshold)
                    keys, sketch = keys.view(np.int64), short_sketch(hashes)
                    size += len(keys)
                for column, value in zip(out, (doc_id, text_key, len(hashes), node, other, need, keys, sketch)):
                    column.append(value)
                if size > 500_000:
                    yield _batch(out)
                    out, size = [[] for _ in range(8)], 0
            yield _batch(out)

    return run


def _batch(columns: list[list]) -> pa.RecordBatch:
    plain, lists = pa.int64(), pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [plain] * 6 + [lists] * 2)],
                                      ["doc_id", "text_key", "n", "node", "other", "need", "keys", "sketch"])


def _named(width: int):
    """(doc_id, text) to (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for _, texts in _parts(batches):
            nodes = []
            for text in texts:
                hashes = shingle_hashes(text, width)
                nodes.append(set_identity(hashes)[0] if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], ["node", "text"])

    return run


def _linked(width: int, threshold: int):
    """(a, b, text_a, text_b) to (a, b, linked)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = None, None
        for a, b, lefts, rights in _parts(batches):
            linked = []
            for left, right in zip(lefts, rights):
                if known[0] != left:
                    known = left, shingle_hashes(left, width)
                x, y = known[1], shingle_hashes(right, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())],
                                             ["a", "b", "linked"])

    return run


def _may_link(threshold: int) -> Column:
    """Whether sizes and short sketches of the sides a and b allow a link."""
    size_a, size_b = F.col("n_a"), F.col("n_b")
    distance = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_WORDS)),
                   F.lit(0))
    return ((F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * threshold)
            & (distance * (100 + threshold) <= (size_a + size_b) * (100 - threshold)))


def _with_info(pairs: DataFrame, info: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(info.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"),
                                       F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))


def _unsettled(members: DataFrame, turn: int) -> DataFrame:
    """Keys under which more than one component meets, with a pivot: the node with the smallest hash in this turn."""
    return (members.withColumn("place", F.xxhash64("node", F.lit(turn))).groupBy("key")
            .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("node", "place").alias("pivot"),
                 F.min_by("label", "place").alias("pivot_label")).where("low <> high").drop("low", "high"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = 5, threshold: int = 80,
                    pivot_rounds: int = 6) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row; linked are rows with 100 * intersection >= threshold * union.

    A row's set are the different ``width``-word shingles of its whole text (all words if there are fewer).
    ``component_id`` is the smallest id reachable by links, the row's own included. Null texts and texts without
    words have no shingles, and their component is their own id. Ids are integers; rows that repeat an id stay, and a
    null id is ignored where the smallest is sought. ``text_key`` is a hash of the text. Steps are written to the shared folder.
    """
    ids = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                      F.xxhash64(text).alias("text_key"))
    rows = materialize(ids.mapInArrow(_sketched(width, threshold), _ROWS), "sketches")
    nodes = rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.max("n").alias("n"),
        (F.min("other") != F.max("other")).alias("clash"))
    nodes = materialize(nodes, "nodes")
    if not nodes.where("clash").isEmpty():
        raise RuntimeError("two different shingle sets have one 64-bit name; change the constant in set_identity")

    pieces = rows.where("keys is not null").select("node", F.explode("keys").alias("key"))
    shared = pieces.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    shared = materialize(shared.select("key"), "shared")
    members = materialize(pieces.join(shared, "key").distinct(), "members")
    labels = _joined_components(ids, rows, nodes, members, width, threshold, pivot_rounds)

    if labels is None:
        of_node = nodes.select("node", F.col("first_id").alias("component"))
    else:
        known = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        lowest = known.groupBy("label").agg(F.min("first_id").alias("component"))
        of_node = known.join(lowest, "label").select("node", "component")
    return (rows.select("doc_id", "text_key", "n", "node").join(of_node, "node", "left")
            .select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def _joined_components(ids: DataFrame, rows: DataFrame, nodes: DataFrame, members: DataFrame, width: int,
                       threshold: int, pivot_rounds: int) -> DataFrame | None:
    """(node, label) of the nodes that have a link to another node."""
    met = members.select("node").distinct()
    sketches = rows.where("sketch is not null").select("node", "need", "sketch").join(met, "node").dropDuplicates(["node"])
    info = materialize(nodes.select("node", "first_id", "n").join(sketches, "node"), "candidates")
    wanted = info.select(F.col("first_id").alias("wanted_id")).distinct()
    if info.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = materialize(
        ids.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
        .select("doc_id", "text").mapInArrow(_named(width), "node long, text string").join(met, "node", "left_semi").dropDuplicates(["node"]),
        "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.select("a", "b"), "pairs")
        few = pairs.count() <= MOST_BROADCAST
        left, right = (texts_of(pairs.select(side).distinct(), side, few) for side in "ab")
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
                           .mapInArrow(_linked(width, threshold), "a long, b long, linked boolean"), "verified")

    def texts_of(ends: DataFrame, side: str, few: bool) -> DataFrame:
        """The texts of these nodes; with few pairs only they are shuffled."""
        own = texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
        return own.join(F.broadcast(ends) if few else ends, side, "left_semi")

    def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
        """Labels after the ends of more links have become one component."""
        edges = links.where("linked").select("a", "b")
        if labels is not None:
            for side in "ab":
                of = labels.select(F.col("node").alias(side), F.col("label").alias("of"))
                edges = edges.join(of, side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
        more = contract(edges)
        if more is None or labels is None:
            return more or labels
        step = more.select(F.col("node").alias("label"), F.col("label").alias("to"))
        moved = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        return materialize(moved.union(more.join(labels, "node", "left_anti")), "labels")

    labels = None
    for turn in range(pivot_rounds):
        with_label = _labelled(members, labels)
        unsettled = materialize(_unsettled(with_label, turn), "unsettled")
        if unsettled.isEmpty():
            return labels
        # a key whose nodes are one component stays settled
        members = materialize(members.join(unsettled.select("key"), "key", "left_semi").select("node", "key"), "members")
        pairs = (_labelled(members, labels).join(unsettled, "key").where("label <> pivot_label")
                 .groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("pieces")))
        best = (_with_info(pairs, info).where(_may_link(threshold)).groupBy("a")
                .agg(F.max_by("b", F.struct("pieces", "b")).alias("b")))
        links = verified(best)
        labels = joined(labels, links)
    with_label = _labelled(members, labels)
    open_keys = with_label.join(_unsettled(with_label, pivot_rounds).select("key"), "key", "left_semi").join(info, "node")
    left, right = (open_keys.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "label", "n", "need", "sketch")))
                   for side in "ab")
    rest = left.join(right, (left["key"] == right["key"]) & (F.col("label_a") < F.col("label_b")) & _may_link(threshold))
    # all keys that nodes of different components share are open
    pairs = (rest.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
             .agg(F.count("*").alias("pieces"), F.min(F.least("need_a", "need_b")).alias("need")).where("pieces >= need"))
    return joined(labels, verified(pairs))


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component only the row with the smallest id stays.

    Of rows that repeat id and text one stays. Rows without words stay; so do rows without an id, unless they are
    linked to a row that has one. Options are those of ``near_duplicates``.
    """
    found = materialize(near_duplicates(docs, key, text, **options), "components")
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.where(~is_first).select("doc_id", "text_key").distinct()
    again = found.where(is_first & (F.col("n_shingles") > 0)).groupBy("doc_id", "text_key").count().where("count > 1")

    def same(rows: DataFrame):
        return docs[key].cast("long").eqNullSafe(rows["doc_id"]) & (F.xxhash64(docs[text]) == rows["text_key"])

    def small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows

    gone = materialize(gone, "gone")
    again = materialize(again.select("doc_id", "text_key"), "again")
    kept = docs.join(small(gone), same(gone), "left_anti")
    if again.isEmpty():
        return kept
    once = docs.join(small(again), same(again), "left_semi").dropDuplicates([key, text])
    return docs.join(small(gone.union(again)), same(gone.union(again)), "left_anti").union(once)
