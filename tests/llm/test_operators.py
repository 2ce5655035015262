"""The training-data operators against plain versions, on the shared tables and on edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from acctsignal.llm import byte_bpe, packing, parity_join
from acctsignal.llm.batches import CHARS_AT_ONCE, Lookup, Remembered, forget, in_chunks, unused_name
from acctsignal.llm.byte_bpe import ByteBpe, decode_ids, encode_texts
from acctsignal.llm.components import contract
from acctsignal.llm.fingerprints import (
    as_text, edited_text, fingerprint_edits, first_edit, leaves, likeness, merkle_tree)
from acctsignal.llm.fixity import archived, audit
from acctsignal.llm.language import fit_languages, predict_language
from acctsignal.llm.license_rules import BASE, rules
from acctsignal.llm.licenses import license_summary, scan_licenses
from acctsignal.llm.packing import best_counts, pack_block, pack_documents
from acctsignal.llm.parity_join import bands, near_duplicates, one_per_group, words_of
from acctsignal.llm.quality import fit_quality, quality_score, word_shape
from acctsignal.llm.shards import shard_documents
from acctsignal.llm.topk import top_k

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"word{i % 977}." for i in range(60_000))
EDGE = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "1234 !?", "de"), (5, "A", "en"), (6, "same text here", "fr"),
        (6, "same text here", "fr"), (7, "same text here", "fr"), (8, LONG, "en"), (9, LONG, "en"), (None, "no id", None),
        (10, "日本語 é ½ <|endoftext|>  x \n \n y", "de"), (11, "\x1c odd \x85 space", None)]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty, very long and repeated texts, repeated and missing ids, and columns with clashing names."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string")
    for name in ("score", "ids", "words", "node", "slot", "shard", "n", "label", "KEY", "licenses", "language"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def query(spark, sf_dir, name):
    return [r.asDict() for r in E.queries()[name](spark, sf_dir).collect()]


# helpers


def test_remembered_values_and_bound():
    asked = []
    known = Remembered(lambda items: (asked.extend(items), [len(x) for x in items])[1], most=3)
    assert known.of(["a", "bb", "a"]) == [1, 2, 1]
    assert known.of(["bb", "ccc"]) == [2, 3] and asked == ["a", "bb", "ccc"]
    for i in range(20):
        assert known.of([f"{i:03}", "bb"]) == [3, 2]
    assert len(known.young) <= 4 and len(known.old) <= 4


def test_lookup_and_forgetting():
    asked = []
    known = Lookup(lambda items: (asked.append(sorted(items)), [len(x) for x in items])[1], most=3)
    other = Remembered(lambda items: [1] * len(items))
    other.of(["x"])
    assert known.holding({"a", "bb"}) == {"a": 1, "bb": 2}
    assert known.holding({"bb", "ccc"})["ccc"] == 3 and asked == [["a", "bb"], ["ccc"]]
    assert known.holding({"bb", "d", "e"}) == {"bb": 2, "d": 1, "e": 1} and known.holding(set()) == known.known
    assert len(known.holding(set("uvwxyz"))) == 6
    forget(known)
    assert len(known.known) == 6 and not other.young
    forget()
    assert not known.known


def test_chunks_keep_order_and_names_are_unused(edge):
    items = ["x" * n for n in (5, 0, CHARS_AT_ONCE * 2, 3)]
    assert [t for _, chunk in in_chunks(items) for t in chunk] == items
    assert unused_name(edge, "key") == "key_" and unused_name(edge, "other") == "other"


# 1 language


def test_language_of_held_out_texts(spark, sf_dir, docs):
    given = {r.doc_id: r.lang for r in docs.collect()}
    rows = query(spark, sf_dir, "op1_language_filters")
    assert sorted(r["doc_id"] for r in rows) == sorted(given)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == given[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(edge, empty, docs):
    model = fit_languages(docs)
    rows = edge.select("doc_id", "text", predict_language(model, F.col("text")).alias("p")).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert (r.p.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    nothing = fit_languages(empty)
    assert {r.p.lang_pred for r in edge.select(predict_language(nothing, F.col("text")).alias("p")).collect()} == {"und"}
    assert empty.select(predict_language(model, F.col("text"))).count() == 0


# 2 licences

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(text):
    words, starts, labels = WORDS.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in BASE.items():
        phrase = phrase.split()
        for k in range(len(words)):
            if words[k:k + len(phrase)] == phrase:
                starts.append(k)
                labels.add(label)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def test_license_counts(spark, sf_dir, texts):
    rows = query(spark, sf_dir, "op2_license_rules")
    assert len(rows) == len(texts)
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))
        assert got == plain_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_license_detections_and_hiding(spark, edge, empty):
    cases = {
        "Licensed under CC BY-NC-SA 4.0, cc-by-nc.": ("cc-by-nc", "cc-by-nc,cc-by-nc-sa"),
        "CC BY NC CC BY NC under the MIT License": ("cc-by-nc,mit", "cc-by-nc,mit"),
        "under the GNU General Public License, version 3.": ("", "gpl-3"),
        "SPDX-License-Identifier: Apache-2.0": ("", "apache-2"),
        "limit license version": ("", ""),
        "License: MIT": ("", "mit"),
        "This is released under MIT": ("", "mit"),
        "This project is MIT licensed": ("", "mit"),
        "GFDL 1.3": ("", "gfdl"),
        "Affero GPL 3": ("", "agpl-3"),
        "Released under the three-clause BSD": ("", "bsd-3-clause"),
        "CC Zero 1.0 Universal": ("", "cc0"),
        "All advertising materials mentioning features or use of this software must display the following "
        "acknowledgement": ("", "bsd-4-clause"),
        "permit the example coupling of templates under pressure": ("", ""),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that": ("", "isc"),
    }
    df = spark.createDataFrame(list(cases.items()), "text string, x struct<a:string,b:string>")
    for r in scan_licenses(df).select("text", *license_summary(F.col("licenses"))).collect():
        assert (r.base_labels, r.labels) == cases[r.text]
    scanned = scan_licenses(edge)
    assert scanned.columns == [*edge.columns, "licenses_"] and scanned.count() == len(EDGE)
    assert [r.n for r in scanned.orderBy("doc_id").select(F.col("licenses_.n_words").alias("n")).collect()][1:3] == [0, 0]
    assert scan_licenses(empty).count() == 0


def test_gates_and_keywords_hide_no_match(spark):
    """Rules found behind gates and keywords are all that match; hiding equals a quadratic comparison."""
    table = rules()
    random = np.random.default_rng(3)
    parts = ["under the MIT license", "apache license version 2", "cc by nc sa", "licensed under the terms of the", "GNU",
             "general public license v2", "lesser", "all rights reserved", "bsd", "3-clause BSD license", "MPL 2.0", "of", ",", "gpl 3"]
    made = [" ".join(random.choice(parts, random.integers(1, 9))) for _ in range(120)]
    rows = scan_licenses(spark.createDataFrame([(t,) for t in made], "text string")).select("text", "licenses.*").collect()
    for r in rows:
        words = " " + " ".join(WORDS.findall(r.text.translate(LOWER))) + " "
        expected = sorted((words[:m.start()].count(" ") - 1, words[:m.end()].count(" ") - 1, rule.name)
                          for rule in table for m in re.finditer(f"(?<= )(?:{rule.regex})(?= )", words))
        assert sorted((d.start, -d.back, d.name) for d in r.found) == expected
        kept = [d for d in r.found if not any(
            (o.start, o.back) != (d.start, d.back) and o.start <= d.start and o.back <= d.back and o.priority >= d.priority
            for o in r.found)]
        spans = lambda ds: {(d.start, d.back, max(o.priority for o in ds if (o.start, o.back) == (d.start, d.back)))
                            for d in ds}
        assert spans(r.kept) == spans(kept)


def test_license_rules_are_many_and_named_once():
    names = [r.name for r in rules()]
    assert len(names) == len(set(names)) > 200
    for r in rules():
        re.compile(r.regex)


# 3 fixity


def test_audit_finds_what_differs_and_nothing_else(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (i % 7) * 1000) for i in range(500)] + [(None, None, None)],
                                  "page_id long, url string, html string")
    original = archived(pages, 100)
    assert audit(original, original).count() == 0
    replica = original.where("record_id is null or record_id <> 30").withColumn(
        "digest", F.when(F.col("record_id") == 444, F.lit("bad")).otherwise(F.col("digest")))
    found = {(r.record_id, r.damage) for r in audit(original, replica).collect()}
    assert found == {(30, "missing"), (444, "changed")}
    assert {(r.record_id, r.damage) for r in audit(replica, original).collect()} == {(30, "extra"), (444, "changed")}
    assert audit(original.limit(0), original.limit(0)).count() == 0
    assert audit(original, original.limit(0)).count() == 501


def test_audit_of_longer_inserted_and_repeated_records(spark):
    """What only moved is no damage; records longer than a range, repeated ids, clashing columns."""
    rows = [(i, f"u{i}", "y" * (i % 5) * 30_000) for i in range(200)] + [(7, "u7", "again"), (7, "u7", "again"), (None, "n", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("place", "node", "nth", "HASH", "parent"):
        pages = pages.withColumn(name, F.lit("mine"))

    def damage(change):
        found = audit(archived(pages, 1000).withColumn("place", F.lit(1)), archived(change(pages), 1000)).collect()
        return sorted((r.record_id, r.damage) for r in found)

    longer = lambda p: p.withColumn("html", F.when(F.col("page_id") == 50, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    assert damage(longer) == [(50, "changed")]
    assert damage(lambda p: p.where("page_id is null or page_id <> 3")) == [(3, "missing")]
    assert damage(lambda p: p.union(p.where("page_id = 9").withColumn("html", F.lit("other")))) == [(9, "extra")]
    assert damage(lambda p: p.dropDuplicates()) == [(7, "missing")]
    assert damage(lambda p: p.where("page_id is not null")) == [(None, "missing")]
    assert damage(lambda p: longer(p).where("page_id is null or page_id <> 190")) == [(50, "changed"), (190, "missing")]


# 4 shards


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_match_the_published_loop(spark, sf_dir, texts):
    rows = query(spark, sf_dir, "op4_jump_shards")
    slots = collections.defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 40), jump(r["doc_id"], 41))
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    for pairs in slots.values():
        assert [s for s, _ in sorted(pairs)] == list(range(len(pairs)))
        assert [d for _, d in sorted(pairs)] == sorted(d for _, d in pairs)


def test_shard_edge_cases(spark, edge, empty):
    rows = shard_documents(edge, 3).collect()
    assert len(rows) == len(EDGE) and {r.shard for r in rows if r.doc_id is None} == {jump(0, 3)}
    assert sorted((r.shard, r.slot) for r in rows) == sorted(
        (s, k) for s, n in collections.Counter(r.shard for r in rows).items() for k in range(n))
    assert shard_documents(empty, 3).count() == 0
    big = spark.createDataFrame([(-5, "x"), (2**63 - 1, "y"), (-2**63, "z")], "doc_id long, text string")
    assert {r.doc_id: r.shard for r in shard_documents(big, 1000).collect()} == {
        k: jump(k, 1000) for k in (-5, 2**63 - 1, -2**63)}


# 5 fingerprints


def plain_fingerprint(text):
    """The tree built from the leaves up, with own code."""
    def digest(data):
        return hashlib.blake2b(data, digest_size=16).digest()

    sections, paragraphs, at = [], [], 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        while stop < len(text) and text[stop] == "\n":
            stop += 1
        rest, parts = text[at:stop], []
        while rest:
            found = re.match(r".{80,400}?(?:[.!?]\s+|$)|.{400}\S{0,400}\s*|.+", rest, re.S)
            leaf = found.group()
            parts.append((digest(leaf.encode()), len(leaf)))
            rest = rest[len(leaf):]
        node = digest(b"p" + b"".join(d for d, _ in parts))
        paragraphs.append((node, parts))
        if text[at:stop].endswith("\n\n") or node[0] % 8 == 0 or stop == len(text):
            leaves_below = ",".join(f"{d[:4].hex()}.{n}" for _, below in paragraphs for d, n in below)
            section = digest(b"s" + b"".join(n for n, _ in paragraphs))
            sections.append((section, leaves_below))
            paragraphs = []
        at = stop
    return ":".join([digest(b"d" + b"".join(d for d, _ in sections)).hex(), *(f"{d[:4].hex()},{x}" for d, x in sections)])


def plain_likeness(a, b):
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    own, other = (sorted(x for s in f.split(":")[1:] for x in s.split(",")[1:]) for f in (a, b))
    size = lambda found: sum(int(x.split(".")[1]) for x in found)
    left, common = list(other), 0
    for leaf in own:
        if leaf in left:
            left.remove(leaf)
            common += size([leaf])
    return common / max(size(own), size(other), 1)


def test_fingerprints_of_all_texts(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in query(spark, sf_dir, "op5_merkle_fingerprints")}
    ids = sorted(texts)
    for doc_id, following in zip(ids, [*ids[1:], ids[0]]):
        edited, r = edited_text(texts[doc_id], texts[following]), rows[doc_id]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(texts[doc_id])
        assert r["fingerprint"] == plain_fingerprint(texts[doc_id]) and r["edited_fingerprint"] == plain_fingerprint(edited)
        # from the returned strings alone
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(plain_likeness(r["fingerprint"], rows[following]["fingerprint"]))
    by_text = collections.defaultdict(set)
    for doc_id in ids:
        by_text[texts[doc_id]].add(rows[doc_id]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({*map(tuple, by_text.values())}) == len(by_text)


def test_trees_locate_edits(texts):
    for text in [*list(texts.values())[:30], LONG, "", "x" * 5000, "\n\n\n"]:
        tree = merkle_tree(text)
        assert sum(leaf.chars for leaf in leaves(tree)) == tree.chars == len(text)
        assert likeness(as_text(tree), as_text(merkle_tree(text))) == 1 and first_edit(tree, merkle_tree(text)) == -1
    text = "\n".join(f"Paragraph {i} says that {i * i} is a square." for i in range(100))
    other = text.replace("Paragraph 60 says", "Paragraph 60 said")
    at = first_edit(merkle_tree(text), merkle_tree(other))
    assert 0 <= text.index("Paragraph 60") - at < 100 and likeness(as_text(merkle_tree(text)), as_text(merkle_tree(other))) > 0.95


def test_fingerprint_edge_cases(edge, empty):
    rows = fingerprint_edits(edge).collect()
    assert len(rows) == len(EDGE)
    order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = collections.Counter((a[0], hashlib.sha256(edited_text(a[1] or "", b[1] or "").encode()).hexdigest())
                               for a, b in zip(order, [*order[1:], order[0]]))
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in rows) == want
    assert fingerprint_edits(empty).count() == 0
    assert fingerprint_edits(edge.where("doc_id = 5")).first().near_next == 1.0


# 6 byte-level BPE


def test_ids_and_texts_match_the_library(spark, sf_dir, texts):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in query(spark, sf_dir, "op6_pair_index_bpe"):
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts_are_cut_as_by_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), ByteBpe(path)
    random = np.random.default_rng(5)
    letters = list(" \n\t\r\xa0\x85\x1c  ab'sC1²½é日😀.,! ́-_<|>") + ["<|endoftext|>", "'ll", " the"]
    for _ in range(1500):
        text = "".join(random.choice(letters, random.integers(0, 25)))
        ids = np.frombuffer(own.encode([text])[0], np.int32).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.zeros(0, np.int32)) == ""
    assert [np.frombuffer(x, np.int32).tolist() for x in own.encode(["a b", "", "c  d <|endoftext|>"])] == [
        library.encode(t, add_special_tokens=False).ids for t in ("a b", "", "c  d <|endoftext|>")]


def test_every_code_point_is_cut_as_by_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), ByteBpe(path)
    texts = [f"x{c}'d 5{c}'re {c}ab" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)])]
    expected = library.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, e, ids in zip(texts, expected, own.encode(texts)) if e.ids != np.frombuffer(ids, np.int32).tolist()]
    assert not wrong


def plain_bpe(own, piece):
    """The lowest rank of neighbours is merged from the left, until none is left."""
    symbols = [own.of_byte[b] for b in piece.encode()]
    while True:
        ranks = [own.rank_of.get(a << 32 | b, 1 << 60) for a, b in zip(symbols, symbols[1:])]
        if not ranks or min(ranks) == 1 << 60:
            return symbols
        rank = min(ranks)
        left, right, merged = own.merges[rank]
        at = 0
        while at < len(symbols) - 1:
            if symbols[at] == left and symbols[at + 1] == right:
                symbols[at:at + 2] = [merged]
            at += 1


@pytest.mark.parametrize("many", [1, 3, 10**9])
def test_pair_index_merges_in_order(monkeypatch, many):
    """Runs of one symbol, long and repeated pieces; with few and with many places at a time."""
    monkeypatch.setattr(byte_bpe, "MANY_PLACES", many)
    own = ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    random = np.random.default_rng(7)
    pieces = ["".join(random.choice(list("aeinst h"), random.integers(1, 40))) for _ in range(300)]
    pieces += ["a" * n for n in range(1, 30)] + ["  " * 20, "the" * 200, "x"]
    assert [np.frombuffer(x, np.int32).tolist() for x in own.merge_all(pieces)] == [plain_bpe(own, p) for p in pieces]
    assert own.merge_all([]) == []


def test_bpe_edge_cases(edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = encode_texts(edge, path)
    assert encoded.columns == edge.columns
    rows = decode_ids(encoded, path).select("text", "decoded").collect()
    assert len(rows) == len(EDGE) and all((r.text or "") == r.decoded for r in rows)
    assert decode_ids(encode_texts(empty, path), path).count() == 0


def test_packed_ids_of_odd_words_are_the_librarys():
    own = packing.word_tokens(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a" + c + "b " + c + ". " + c * 2 for c in map(chr, range(1, 0x600))] + ["İstanbul. ÀÉ'll 12ab ª º ǆ ß ŉ", "日本 a1b2 x́y é́"]
    expected = own.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
    assert [np.frombuffer(x, np.uint32).tolist() for x in own.ids(odd)] == [e.ids for e in expected]


# 7 quality


def test_quality_of_held_out_texts(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest has too few labels to learn from
    given = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = query(spark, sf_dir, "op7_quality_ftrl")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    for held_out, least in ((True, 0.93), (False, 0.97)):
        known = [r for r in rows if r["doc_id"] in given and r["held_out"] == held_out]
        assert np.mean([r["predicted"] == given[r["doc_id"]] for r in known]) > least


def test_quality_edge_cases(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1), (6, 1), (4, 0), (4, None), (None, 1), (8, 7), (6, 0), (6, 1)],
                                   "doc_id long, quality int")
    model = fit_quality(edge, labels)
    rows = edge.select(quality_score(model, F.col("text")).alias("s")).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.s <= 1 for r in rows)
    untrained = fit_quality(edge, labels.limit(0))
    assert {r.s for r in edge.select(quality_score(untrained, F.col("text")).alias("s")).collect()} == {0.5}
    assert fit_quality(empty, labels).score("x") == 0.5
    assert word_shape("Hello,,World12!") == "Aa,Aa0!"


# 8 packing


def test_pieces_and_sequences(spark, sf_dir, texts):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = query(spark, sf_dir, "op8_min_bin_slack")
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)


def test_subset_sums_are_the_closest():
    random = np.random.default_rng(3)
    for _ in range(200):
        counts = {int(n): int(c) for n, c in zip(random.integers(1, 40, 4), random.integers(1, 4, 4))}
        room = int(random.integers(0, 90))
        taken, sums = best_counts(counts, room), {0}
        assert all(taken[n] <= counts[n] for n in taken)
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


def test_blocks_hold_every_token_once():
    random = np.random.default_rng(4)
    for lengths in ([], [1], [4096], [4097, 1], [3], [2, 2, 2], *(random.integers(1, 300, 40).tolist() for _ in range(20))):
        seen = collections.Counter()
        for sequence in pack_block(lengths, 64):
            size = sum(p[2] for p in sequence)
            assert size == 64 or size & (size - 1) == 0
            for doc, start, n in sequence:
                seen.update((doc, k) for k in range(start, start + n))
        assert seen == collections.Counter({(d, k): 1 for d, n in enumerate(lengths) for k in range(n)})


def test_word_ids_of_odd_texts():
    own = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    random = np.random.default_rng(6)
    letters = list(" \n\t\xa0\x85\x1c  ab'sC1²é日😀.,!İΣ ́-_<|>") + ["<|endoftext|>", "'ll"]
    texts = ["".join(random.choice(letters, random.integers(0, 25))) for _ in range(1000)]
    for text, ids in zip(texts, own.ids(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_edge_cases(edge, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = pack_documents(edge, path).collect()
    assert sum(r.length for r in rows if r.doc_id in (1, 2, 3)) == 3
    assert pack_documents(empty, path).count() == 0


# 9 exact top-k


def plain_top(vectors, k):
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = set()
    for q, v in {i: v for i, v in sorted(rows, reverse=True)}.items():
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
            found |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return found


def test_top_k_of_all_vectors(spark, sf_dir):
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {tuple(r.values()) for r in query(spark, sf_dir, "op9_histogram_topk")} == plain_top(vectors, 10)


def test_top_k_edge_cases(spark):
    nan = float("nan")
    rows = ([(i, [0.5, 0.25]) for i in range(0, 60)] + [(i, [0.5, -float(i)]) for i in range(90, 120)]
            + [(200, None), (300, [nan, 1.0]), (400, [None, 1.0]), (None, [1.0, 1.0]), (500, [1.0]), (600, []), (601, [])])
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(5)
    got = {tuple(r) for r in top_k(df, df.where("vec_id % 100 = 0"), 4, vector="v").collect()}
    assert got == plain_top(rows, 4)
    assert top_k(df.limit(0), df.limit(0), vector="v").count() == 0


def test_top_k_in_several_blocks(spark, sf_dir, monkeypatch):
    from acctsignal.llm import topk
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 2)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    assert {tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), 10).collect()} == plain_top(vectors, 10)


# 10 near-duplicates


def plain_components(rows, width, threshold):
    """Set sizes and components, by counting common shingles of all pairs that have one."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent, having = list(range(len(rows))), collections.defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in having[x])
        for x in s:
            having[x].append(i)
        for j, n in common.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    lowest = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return collections.Counter((rows[i][0], len(sets[i]), lowest[root(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("width, threshold", [(3, 90), (5, 80)])
def test_components_of_all_texts(docs, texts, width, threshold):
    got = near_duplicates(docs, width=width, threshold=threshold).drop("text_key").collect()
    want = plain_components(sorted(texts.items()), width, threshold)
    assert collections.Counter(tuple(r) for r in got) == want
    assert any(d != c for d, _, c in want)


def test_chains_and_groups_of_near_copies(spark):
    random = np.random.default_rng(7)
    base, rows = [f"w{i}" for i in range(120)], []
    for group in range(3):
        text = [f"g{group}{w}" for w in base]
        for copy in range(120):  # a walk: neighbours are alike, ends are not
            if copy % 3:
                text[random.integers(len(text))] = f"new{group}.{copy}"
            rows.append((int(random.integers(1 << 40)), " ".join(text[:100 + copy % 5])))
    rows += [(i, " ".join(f"s{k}" for k in range(n))) for i, n in enumerate([1, 2, 2, 3, 10, 11, 11, 12, 13])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for width, threshold in ((3, 90), (2, 80)):
        got = near_duplicates(df, width=width, threshold=threshold).drop("text_key").collect()
        assert collections.Counter(tuple(r) for r in got) == plain_components(rows, width, threshold)


def test_bands_and_pieces_lose_no_pair():
    for threshold in (80, 90):
        for a in range(1, 3000, 7):
            b = a * 100 // threshold
            assert any(low <= a and b <= high for low, high, _ in bands(threshold))
    random = np.random.default_rng(8)
    for size in (3, 9, 12, 40, 300, 5000):
        a = random.integers(1, 2**63, size).astype(np.uint64)
        b = np.unique(np.r_[a[:size - size // 20], random.integers(1, 2**63, size // 20 // 2).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            keys = [set(parity_join.piece_keys(np.unique(x), 90).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_similar_sets_have_the_equal_pieces_they_need():
    random = np.random.default_rng(9)
    for threshold in (80, 90):
        sizes = [n for low, high, _ in bands(threshold, 6000) for n in (low, low + 1, (low + high) // 2, high)]
        for size in (n for n in sizes if n < 6000):
            whole = np.unique(random.integers(1, 2**63, size).astype(np.uint64))
            gone = random.permutation(whole)[:size * (100 - threshold) // 100]  # as unlike as a link allows
            half = len(gone) // 2
            for b in (np.setdiff1d(whole, gone), np.setdiff1d(whole, gone[:half])):
                for a in (whole, np.setdiff1d(whole, gone[half:])):
                    both = len(np.intersect1d(a, b))
                    if 0 < threshold * (len(a) + len(b) - both) <= 100 * both:
                        (keys, need), (others, of_other) = (parity_join.keys_and_need(x, threshold) for x in (a, b))
                        assert 1 <= min(need, of_other) <= len(np.intersect1d(keys, others)), (size, threshold)


def test_unlike_long_texts_are_not_compared_pair_by_pair(spark, monkeypatch):
    """60 long texts with a common passage and too many shingles for the short sketch, each with a near copy."""
    random = np.random.default_rng(10)
    passage, rows = " ".join(f"common{i}" for i in range(150)), []
    for i in range(60):
        words = [f"w{w}" for w in random.integers(0, 1 << 40, 2600)]
        rows.append((i, f"{' '.join(words)} {passage}"))
        rows.append((100 + i, f"{' '.join(words[40:])} {passage}"))
    written, write = collections.Counter(), parity_join.materialize

    def counted(df, name):
        out = write(df, name)
        written[name] += out.count() if name == "verified" else 0
        return out

    monkeypatch.setattr(parity_join, "materialize", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, pivot_rounds=1).collect()}
    assert got == {i: i % 100 for i, _ in rows}
    assert written["verified"] < 3 * len(rows)


def test_near_duplicate_edge_cases(edge, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(edge).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (6, 1, 6), (7, 1, 6), (9, 977, 8), (None, 1, None)} <= got
    assert near_duplicates(empty).count() == 0
    kept = one_per_group(edge)
    assert kept.columns == edge.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([1, 2, 3, 4, 5, 6, 8, None, 10, 11])
    assert one_per_group(empty).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    labels = {r.node: r.label for r in contract(edges).collect()}
    assert {labels[i] for i in range(51)} == {0} and labels[101] == labels[100] == 100
    assert contract(edges.where("a = b")) is None


# the pipeline


def test_stages_keep_columns_and_take_effect(spark, sf_dir, docs):
    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        then = stage(spark, now, sf_dir).cache()
        assert then.columns == docs.columns
        sizes.append(then.count())
        now = then
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2] and sizes[3] > 0.7 * sizes[0]
    rows = now.select("doc_id", "text").collect()
    assert len(plain_components([tuple(r) for r in rows], 5, 80)) == len(rows)
    packed = corpus_pipeline.pack(spark, now, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_pipeline_edge_cases(spark, sf_dir, edge, empty):
    for rows in (edge, empty):
        now = rows.withColumn("doc_id", F.col("doc_id"))
        for _, stage in corpus_pipeline.STAGES[1:3]:
            now = stage(spark, now, sf_dir)
            assert now.columns == rows.columns
        assert corpus_pipeline.pack(spark, now, sf_dir).count() >= 0
