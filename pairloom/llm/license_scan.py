"""License detection by ordered signature rules, as one projection over the row."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .license_rules import ANCHORS, BASE, Rule, rules

#: On text that is not lower-cased; Java is faster with classes that name what is in them.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPAN = "array<struct<start:int,end:int,priority:int,confidence:double,label:string>>"


def _spaces(text: Column) -> Column:
    """Words in a piece that gives each of its words one space before it."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _matches(reduced: Column, rule: Column) -> Column:
    """The places of one rule: words between matches are counted from the pieces around them."""

    def walk(pieces: Column, found: Column) -> Column:
        def step(state: Column, match: Column) -> Column:
            start = state["at"] + _spaces(F.get(pieces, F.size(state["out"])))
            end = start + _spaces(match)
            one = F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), rule["label"].alias("label"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(found, begin, step, lambda state: state["out"])

    def both(found: Column) -> Column:
        return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(
            let(F.split(reduced, rule["pattern"], -1), lambda pieces: walk(pieces, found))
        )

    return let(F.regexp_extract_all(reduced, rule["pattern"], F.lit(0)), both)


def _unsuppressed(detections: Column, priorities: Sequence[int]) -> Column:
    """Detections that no other one of at least their priority contains (of equal ones the
    first label stays), in the order of their starts.

    Sorted by start and falling end, whatever contains a detection stands before it, so
    the furthest end so far of each priority decides.
    """
    order = F.transform(detections, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("rank"), d["label"].alias("label"), d["confidence"].alias("confidence")))

    def step(state: Column, d: Column) -> Column:
        reach = state["reach"]
        above = F.array_max(F.slice(reach, 1 - d["rank"], len(priorities_all)))
        inside = above >= -d["back"]
        grown = F.transform(reach, lambda r, i: F.when(i == -d["rank"], F.greatest(r, -d["back"])).otherwise(r))
        kept = F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(F.struct(
            d["start"].alias("start"), (-d["back"]).alias("end"), (-d["rank"]).alias("priority"), d["confidence"].alias("confidence"), d["label"].alias("label")))))
        return F.struct(grown.alias("reach"), kept.alias("kept"))

    priorities_all = range(max(priorities) + 1)
    begin = F.struct(F.array_repeat(F.lit(-1), len(priorities_all)).alias("reach"), F.array().cast(_SPAN).alias("kept"))
    return F.aggregate(F.array_sort(order), begin, step, lambda state: state["kept"])


def _base(reduced: Column, n_words: Column) -> Column:
    """For each base phrase: its label, number of places, first and last start."""
    def one(label: str, phrase: str) -> Column:
        size = len(phrase.split())
        return let(
            F.split(reduced, f" {phrase}(?= )", -1),
            lambda p: F.struct(
                F.lit(label).alias("label"), (F.size(p) - 1).alias("n"), F.when(F.size(p) > 1, _spaces(p[0])).alias("first"),
                F.when(F.size(p) > 1, n_words - (_spaces(F.element_at(p, -1)) - 1) - size).alias("last"),
            ),
        )

    return F.array(*[one(label, phrase) for label, phrase in BASE])


def _keywords(chosen: Sequence[Rule]) -> list[str]:
    return sorted({f" {k}" for r in chosen for k in r.keyword.split("|")})


def _table(chosen: Sequence[Rule]) -> Column:
    place = {k: i for i, k in enumerate(_keywords(chosen))}
    rows = [[r.label, f" (?:{r.pattern})(?= )", [place[f" {k}"] for k in r.keyword.split("|")], r.priority, r.confidence] for r in chosen]
    names = ("label", "pattern", "keyword", "priority", "confidence")
    return F.from_json(F.lit(json.dumps([dict(zip(names, row)) for row in rows])), "array<struct<label:string,pattern:string,keyword:array<int>,priority:int,confidence:double>>")


def scan(docs: DataFrame, chosen: Sequence[Rule] | None = None) -> DataFrame:
    """``(doc_id, n_words, base, detections)``, one row per row of ``docs``.

    ``base`` holds the number and the first and last word of each base phrase;
    ``detections`` the spans of words (from 0, end excluded) that are left after
    suppression. A null text has no words. Nothing is shuffled and every rule sees the
    whole text; a rule's pattern is tried only where one of its keywords stands.
    """
    chosen = list(rules() if chosen is None else chosen)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    table = _table(chosen)
    keywords = F.from_json(F.lit(json.dumps(_keywords(chosen))), "array<string>")

    def found(reduced: Column) -> Column:
        present = F.transform(keywords, lambda k: F.contains(reduced, k))
        tried = let(present, lambda p: F.filter(table, lambda r: F.exists(r["keyword"], lambda k: F.get(p, k))))
        spans = F.flatten(F.transform(tried, lambda r: _matches(reduced, r)))
        n_words = _spaces(reduced) - 1
        return F.struct(_base(reduced, n_words).alias("base"), let(spans, lambda d: _unsuppressed(d, [r.priority for r in chosen])).alias("detections"))

    def looked_at(lowered: Column) -> Column:
        anchored = F.lit(False)
        for anchor in ANCHORS:
            anchored = anchored | F.contains(lowered, F.lit(anchor.split()[0]))
        reduced = F.concat(F.lit(" "), F.btrim(F.regexp_replace(lowered, _BETWEEN, " ")), F.lit(" "))
        return F.when(anchored, let(reduced, found))

    row = F.struct(F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), let(F.lower(text), looked_at).alias("f"))
    scanned = docs.select("doc_id", let(row, lambda r: r).alias("r"))
    return scanned.select("doc_id", "r.n_words", F.col("r.f.base").alias("base"), F.coalesce("r.f.detections", F.array().cast(_SPAN)).alias("detections"))


def summary(scanned: DataFrame) -> DataFrame:
    """Base counts, all labels and the highest confidence of each row."""
    hits = F.filter(F.coalesce("base", F.array().cast("array<struct<label:string,n:int,first:int,last:int>>")), lambda b: b["n"] > 0)
    base_labels = F.transform(hits, lambda b: b["label"])
    labels = F.array_union(base_labels, F.transform("detections", lambda d: d["label"]))
    confidence = F.concat(F.transform(hits, lambda b: F.lit(0.7)), F.transform("detections", lambda d: d["confidence"]))
    return scanned.select(
        "doc_id", "n_words",
        F.aggregate(hits, F.lit(0).cast("long"), lambda total, b: total + b["n"]).alias("n_base"),
        F.array_min(F.transform(hits, lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(hits, lambda b: b["last"])).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base_labels))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(labels))).alias("labels"),
        F.coalesce(F.array_max(confidence), F.lit(0.0)).alias("score"),
    )
