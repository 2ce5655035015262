"""Licence detection with ordered signature rules, as one projection over the texts."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctsignal.llm.batches import unused_name
from acctsignal.llm.license_rules import GATES, PRIORITIES, Rule, rules

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MATCH, _END = "\u0001", "\u0002"  # no word holds them
FOUND = "array<struct<start:bigint,back:bigint,rank:int,name:string,label:string,priority:int,confidence:double>>"


def word_text(text: Column) -> Column:
    """A text's words in lower case, a space before, between and behind them; two spaces if there is none.

    Letters outside A-Z are lowered too: none of them becomes part of a word boundary or of a base phrase.
    """
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NO_WORD, " ")), F.lit(" "))


def count_spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _rule_table(table: list[Rule]) -> Column:
    """The rules as one constant array of structs."""
    rows = [r._asdict() | {"regex": f"(?<= )({r.regex})(?= )"} for r in table]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,label:string,keywords:array<string>,"
                       "priority:int,confidence:double,regex:string>>")


def _places(words: Column, rule: Column) -> Column:
    """The rule's matches in a text: their first and last word.

    Every match is marked, the text is cut at the marks, and the spaces before a match count the words before it.
    """
    parts = F.split(F.regexp_replace(words, rule["regex"], F.lit(f"{_MATCH}$1{_END}")), _MATCH)

    def add(state: Column, part: Column) -> Column:
        last = state["at"] + count_spaces(F.substring_index(part, _END, 1))
        place = F.struct(state["at"].alias("start"), (-last).alias("back"), (-rule["priority"]).alias("rank"),
                         rule["name"].alias("name"), rule["label"].alias("label"), rule["priority"].alias("priority"),
                         rule["confidence"].alias("confidence"))
        return F.struct((state["at"] + count_spaces(part)).alias("at"),
                        F.concat(state["found"], F.array(place)).alias("found"))

    begin = F.struct((count_spaces(parts[0]) - 1).alias("at"), F.array().cast(FOUND).alias("found"))
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), begin, add)["found"]


def _unhidden(found: Column) -> Column:
    """Detections that lie in no other of at least their priority.

    In the order of first word, longest first, highest priority first, whatever contains a detection comes before it.
    So it is enough to carry, for each priority, the largest end so far among detections of this priority or a higher.
    """
    names = [f"end{p}" for p in range(1, PRIORITIES + 1)]

    def step(state: Column, d: Column) -> Column:
        end = -d["back"]
        own = F.element_at(F.array(*(state[n] for n in names)), d["priority"])
        kept = F.when(own >= end, state["kept"]).otherwise(F.concat(state["kept"], F.array(d)))
        return F.struct(*(F.when(d["priority"] >= p, F.greatest(state[n], end)).otherwise(state[n]).alias(n)
                          for p, n in enumerate(names, 1)), kept.alias("kept"))

    begin = F.struct(*(F.lit(-1).cast("long").alias(n) for n in names), F.array().cast(FOUND).alias("kept"))
    return F.aggregate(F.array_sort(found), begin, step)["kept"]


def scan_licenses(docs: DataFrame, text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """``docs`` with a struct ``licenses`` (underscores are added if there is such a column).

    ``n_words``; ``found``, all detections, and ``kept``, those that are not hidden, as structs with ``start``
    (number of the first word), ``back`` (minus the last word's number), ``name`` of the rule, ``label``, ``priority`` and
    ``confidence``. Words are runs of letters and digits, and of anything beyond ASCII. Null and empty texts have
    no words and no detection. Rules are tried only in texts that contain one of their keywords; a few strings, of
    which every keyword contains one, tell most texts without any.
    """
    table = table or rules()
    given = docs.columns
    words, spans = unused_name(docs, "words"), unused_name(docs, "spans")
    any_gate = reduce(lambda a, b: a | b, (F.col(words).contains(g) for g in GATES))
    tried = F.filter(_rule_table(table), lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col(words), k)))
    found = F.flatten(F.transform(tried, lambda r: _places(F.col(words), r)))
    scanned = docs.withColumn(words, word_text(F.col(text))).withColumn(
        spans, F.when(any_gate, found).otherwise(F.array().cast(FOUND)))
    n_words = F.when(F.length(words) > 2, count_spaces(F.col(words)) - 1).otherwise(0)
    return scanned.select(*given, F.struct(n_words.alias("n_words"), F.col(spans).alias("found"),
                                           _unhidden(F.col(spans)).alias("kept")).alias(unused_name(docs, "licenses")))


def license_summary(licenses: Column) -> list[Column]:
    """Counts and labels of a scan: base detections at all places, labels of what is kept and of the base."""
    base = F.filter(licenses["found"], lambda d: d["name"].startswith("base:"))
    starts = F.transform(base, lambda d: d["start"])

    def joined(detections: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")

    confidence = F.array_max(F.transform(licenses["kept"], lambda d: d["confidence"]))
    return [licenses["n_words"].alias("n_words"), F.size(base).cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
            joined(base).alias("base_labels"), joined(F.concat(base, licenses["kept"])).alias("labels"),
            F.coalesce(confidence, F.lit(0.0)).alias("score"), F.size(licenses["kept"]).cast("long").alias("n_kept")]
