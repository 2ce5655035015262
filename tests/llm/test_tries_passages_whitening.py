"""Prefix tries, passage removal and whitening against plain versions, on the shared tables and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from acctsignal.llm import substrings
from acctsignal.llm.prefix_trie import DIGEST, Forest, common_turns, prefix_trie, sequences
from acctsignal.llm.substrings import covered, remove_repeated
from acctsignal.llm.whitening import whiten


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# 11 prefix trie


def plain_trie(conversations):
    """{conv_id: [(name, size), …]} to rows, prefix by prefix."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, turns in conversations.items():
        ends[tuple(turns)].append(conv)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = Counter(), Counter()
    for prefix, convs in members.items():
        own = (len(convs) - 1) * (prefix[-1][1] if prefix else 0)
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += prefix not in children
            saved[prefix[:d]] += own
    return sorted((min(convs), len(p), min(members[p[:-1]]) if p else -1, len(convs), len(children.get(p, ())), leaves[p],
                   saved[p], sha(",".join(map(str, sorted(ends.get(p, ())))))) for p, convs in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in rows_of(df))


def read_conversations(rows):
    """Rows (conv_id, turn, role, text) as the sequences of the trie."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = sha(f"{len(role)}:{role}{text}")[:DIGEST]
            found[conv].append((turn is not None, turn or 0, digest, len(text)))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in found.items()}


def test_trie_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    own = read_conversations((r.conv_id, r.turn, r.role, r.text) for r in rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert trie_rows(E.queries()["op11_lcp_trie"](spark, sf_dir)) == plain_trie(rebuilt)


@pytest.mark.parametrize("seed", range(6))
def test_trie_of_random_conversations(spark, seed):
    """Few different turns, so that prefixes are shared; in one range, in many, and with ranges full of equal ones."""
    draw = random.Random(seed)
    size = {d: draw.randrange(50) for d in "abc"}
    conversations = {c: [(d * DIGEST, size[d]) for d in draw.choices("abc", weights=(6, 2, 1), k=draw.choice((0, 1, 2, 3, 7)))]
                     for c in draw.sample(range(-300, 3000), draw.choice((1, 2, 40, 400)))}
    if seed % 2:
        conversations.update({c: [(d * DIGEST, size[d]) for d in "ab"] for c in range(5000, 5200)})
    df = spark.createDataFrame([(c, t) for c, t in conversations.items()],
                               "conv_id long, turns array<struct<digest: string, size: int>>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_rows(prefix_trie(df)) == plain_trie(conversations)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_edge_cases(spark):
    assert prefix_trie(spark.createDataFrame([], "conv_id long, turns array<struct<digest: string, size: int>>")).count() == 0
    rows = [(1, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, 0, "user", "hi"), (None, 0, "user", "hi"),
            (3, 5, "us", "erhi"), (4, 0, "user", "x" * 300_000), (5, None, "user", ""), (5, None, "", "user"),
            *[(6, t, "user", str(t % 7)) for t in range(2000)], *[(7, t, "user", str(t % 7)) for t in range(1990)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("turns", "sequence", "key", "DIGEST"):
        df = df.withColumn(name, F.lit("mine"))
    found = sequences(df)
    assert {r.conv_id: len(r.turns) for r in found.collect()} == {1: 3, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2000, 7: 1990}
    assert trie_rows(prefix_trie(found)) == plain_trie(read_conversations(rows))


def test_common_turns_and_union_order():
    a, b, c = ("x" * DIGEST, "y" * DIGEST, "z" * DIGEST)
    assert common_turns("", a) == 0 and common_turns(a + b, a + b) == 2 and common_turns(a + b + c, a + b + a) == 2
    root = Forest([(a, [1], [4]), (a + b, [1, 2], [9]), (a + c, [1, 2], [2, 3])]).build()
    assert (root.depth, root.conv, root.n, root.children, root.leaves, root.saved) == (0, 2, 4, 1, 2, 3 + 2)


# 12 passages


def plain_removal(docs, window):
    """(doc_id, text) rows to (doc_id, n_words, spans, kept)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    smallest = {}
    for (i, _), w in zip(docs, words):
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k:k + window])
            smallest[key] = min(smallest.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if smallest[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        spans, at = [], 0
        while at < len(w):
            stop = at
            while stop < len(w) and gone[stop] == gone[at]:
                stop += 1
            if gone[at]:
                spans.append((at, stop))
            at = stop
        out.append((-1 if i is None else i, len(w), spans, " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def removal_rows(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], [(s["start"], s["stop"]) for s in r["removed"]],
                   r["kept"]) for r in rows_of(df))


def test_removal_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = [(i, n, sum(b - a for a, b in spans), sha(kept)) for i, n, spans, kept in plain_removal(docs, 50)]
    rows = E.queries()["op12_window_dedup"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == expected
    assert sum(e[2] for e in expected) > 0


@pytest.mark.parametrize("seed,window", [(0, 3), (1, 2), (2, 5), (3, 1)])
def test_removal_of_random_texts(spark, monkeypatch, seed, window):
    """Small blocks and slabs, so that windows meet in one block and across blocks."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 200)
    monkeypatch.setattr(substrings, "SLAB_BYTES", 16)
    draw = random.Random(seed)
    vocabulary = ["a", "b", "é", "日本語", "x\x00", "\x00x", "long" * 9, "\x1c", "\x85"]
    docs = [(draw.randrange(60) if draw.random() < 0.95 else None,
             draw.choice((" ", "\t\n", " \r ")).join(draw.choices(vocabulary, k=draw.randrange(14))) if draw.random() < 0.95 else None)
            for _ in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("block", "place", "removed", "KEPT", "range"):
        df = df.withColumn(name, F.lit("mine"))
    assert removal_rows(remove_repeated(df, window)) == plain_removal(docs, window)


def test_removal_edge_cases(spark):
    assert remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"w{i}" for i in range(400_000))
    same = " ".join(["same"] * 120)
    docs = [(1, long), (2, long), (3, same), (3, same), (4, same + " tail"), (None, same), (5, ""), (6, None), (7, " ".join(["x"] * 49))]
    found = removal_rows(remove_repeated(spark.createDataFrame(docs, "doc_id long, text string")))
    assert [(i, n, spans) for i, n, spans, _ in found] == [
        (-1, 120, []), (1, 400_000, []), (2, 400_000, [(0, 400_000)]), (3, 120, []), (3, 120, []), (4, 121, [(0, 120)]),
        (5, 0, []), (6, 0, []), (7, 49, [])]
    assert found[5][3] == "tail" and found[2][3] == ""


def test_covered_words():
    assert covered(np.array([0, 1, 6]), 3, 9).tolist() == [True] * 4 + [False] * 2 + [True] * 3


# 13 whitening


def grid(vector, scale=64, shift=1_000_000):
    return [int(np.floor(scale * float(np.float32(c)))) + shift for c in vector]


def check_whitening(rows, vectors, components, weights=None):
    """``rows`` (id, n, deviation, whitened, explained, identity_error) against plain numpy over ``vectors`` {id: x}."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=object)
    weights = weights or [1] * len(ids)
    n, s = sum(weights), (x * np.array(weights, dtype=object)[:, None]).sum(axis=0)
    centred = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    covariance = (centred * np.array(weights, dtype=float)[:, None]).T @ centred / n
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    kept = min(components, int((e > e[0] * 1e-12).sum()))
    assert len(rows) == len(ids)
    got = {r[0]: r for r in rows}
    for i, row, z in zip(ids, x, centred):
        _, count, deviation, whitened, explained, error = got[i]
        assert (count, deviation) == (n, sum((n * a - b) ** 2 for a, b in zip(row, s)))
        assert len(whitened) == len(explained) == kept and error <= 1e-4
        np.testing.assert_allclose(explained, e[:kept] / np.trace(covariance), rtol=1e-9)
    whitened = np.array([got[i][3] for i in ids])
    expected = centred @ v[:, :kept] / np.sqrt(e[:kept])
    signs = np.sign((whitened * expected).sum(axis=0))
    np.testing.assert_allclose(whitened, expected * signs, atol=1e-6)
    again = (whitened * np.array(weights, dtype=float)[:, None]).T @ whitened / n
    assert np.abs(again - np.eye(kept)).max() <= 1e-4


def whitened_rows(df):
    return [(r["vec_id"], *r["whitening"].values()) for r in rows_of(df.select("vec_id", "whitening"))]


def test_whitening_query(spark, sf_dir):
    given = {r.vec_id: grid(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    rows = rows_of(E.queries()["op13_weighted_whitening"](spark, sf_dir).orderBy("vec_id", "component"))
    assert [r["component"] for r in rows] == list(range(1, 33)) * len(given)
    grouped = defaultdict(list)
    for r in rows:
        grouped[r["vec_id"]].append(r)
    check_whitening([(i, g[0]["n"], g[0]["deviation"], [r["whitened"] for r in g], [r["explained"] for r in g],
                      g[0]["identity_error"]) for i, g in grouped.items()], given, 32)


def test_whitening_of_copies_and_unusable_rows(spark):
    draw = np.random.default_rng(5)
    vectors = {i: draw.normal(size=3).tolist() for i in range(60)}
    vectors.update({i: [0.5, -2.0, 7.25] for i in range(100, 200)})
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 2.0]), (903, [float("inf"), 0.0, 0.0]), (904, []),
           (905, [1.0]), (906, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([*vectors.items(), *bad], "vec_id long, embedding array<double>")
    for name in ("x", "n", "whitened", "_copies", "COMPONENT"):
        df = df.withColumn(name, F.lit("mine"))
    exact = {i: [int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in vectors.items()}
    found = whiten(df, components=8)
    assert "mine" == found.first()["x"]
    check_whitening(whitened_rows(found), exact, 8)
    # once per distinct vector
    once = {r[0]: r for r in whitened_rows(whiten(df, components=2, counted=False))}
    distinct = {i: v for i, v in exact.items() if i <= 100}
    check_whitening([once[i] for i in distinct], distinct, 2)
    assert len({tuple(once[i][3]) for i in range(100, 200)}) == 1


def test_whitening_without_directions(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    same = whitened_rows(whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)))
    assert [r[1:] for r in same] == [(3, 0, [], [], 0.0)] * 3
    line = whitened_rows(whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], schema)))
    assert sorted(abs(r[3][0]) for r in line) == pytest.approx([1, 1]) and all(len(r[3]) == 1 for r in line)
