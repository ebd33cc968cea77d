"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by containment.

Method: hundreds of regexes over the words of a text. A rule's keyword must stand in the document before its regex is
tried; an anchor that each alternative of each rule holds, ends with most documents. A detection that lies inside another one of the same or
higher priority is suppressed; of equal intervals the one of higher priority, then of the earlier rule stays.
The rules' list is a constant of the plan, nothing is shuffled, and no rows leave the JVM.

Null or empty text: no words, no detections. Null or repeated doc_id, repeated rows and extra columns: each row
is judged by itself; a column named as the result is replaced. Empty table: empty result. Very long texts with very
many detections: lists are built in blocks, so the work does not grow with the square of their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, constants, count_parts, free, let, need, parts, scanned, spans, squeezed
from .license_rules import ANCHORS, rules

#: Phrases that always count, whatever the rules say, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
KINDS = 4
DETECTION = "array<struct<start:int,neg_end:int,neg_priority:int,rule:int,confidence:double,label:string,part:string>>"


def base_places(words: Column) -> Column:
    """Array of (place, label) of each place where a base phrase's words stand consecutively."""

    def one(w: Column, phrase: str, label: str) -> Column:
        p = phrase.split(" ")
        at = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(w, i + k) == x, F.lit(False)) for k, x in enumerate(p)]))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))

    return F.concat(*[one(words, p, label) for p, label in BASE.items()])


def detections(padded: Column) -> Column:
    """What the rules find in words joined by one space, with a space at either end; not yet suppressed."""
    each = rules()
    keywords, patterns = constants([r.keyword for r in each]), constants([rf"(?<= )(?:{r.pattern})(?= )" for r in each])
    labels, confidences, priorities = constants([r.label for r in each]), constants([r.confidence for r in each], "double"), constants([r.priority for r in each], "int")

    def of(r: Column) -> Column:
        return F.transform(
            spans(padded, F.get(patterns, r)),
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("neg_end"), (-F.get(priorities, r)).alias("neg_priority"), r.alias("rule"), F.get(confidences, r).alias("confidence"), F.get(labels, r).alias("label"), s["part"].alias("part")
            ),
        )

    tried = F.filter(F.sequence(F.lit(0), F.lit(len(each) - 1)), lambda r: F.contains(padded, F.get(keywords, r)))
    return F.sort_array(F.flatten(F.transform(tried, of))).cast(DETECTION)


def unsuppressed(found: Column) -> Column:
    """Detections in order of start, then the longest, highest and earliest first: one that ends no later than
    an earlier one of at least its priority lies inside it. The farthest end by priority is all the state needed."""
    ends = [f"end{k}" for k in range(1, KINDS + 1)]

    def reach(state: Column, d: Column) -> Column:
        return reduce(lambda x, k: F.greatest(x, F.when(-d["neg_priority"] <= k, state[ends[k - 1]]).otherwise(F.lit(-1))), range(1, KINDS + 1), F.lit(-1))

    def step(state: Column, d: Column) -> Column:
        return F.struct(*[F.greatest(state[e], F.when(-d["neg_priority"] == k, -d["neg_end"]).otherwise(F.lit(-1))).alias(e) for k, e in enumerate(ends, 1)])

    before = scanned(found, F.struct(*[F.lit(-1).alias(e) for e in ends]), step)
    return let(before, lambda at: F.filter(found, lambda d, i: reach(F.get(at, i), d) < -d["neg_end"]))


def license_scan(docs: DataFrame, *, text: str = "text", out: str = "license") -> DataFrame:
    """The input's columns and a struct ``out``: n_words, base (places and labels), detections
    (start and end in the normalised text, priority, confidence, label, matched words), labels, score."""
    need(docs, text)
    # The words in their case serve the count and the gate; only texts that hold a keyword are lower-cased exactly.
    words, scan = free(docs, "_words"), free(docs, "_scan")
    rows = docs.withColumn(words, squeezed(F.col(text)))
    gate = let(F.lower(F.col(words)), lambda s: F.exists(constants(list(ANCHORS)), lambda a: F.contains(s, a)))
    none = F.struct(F.array().cast("array<struct<place:bigint,label:string>>").alias("base"), F.array().cast(DETECTION).alias("found"))
    some = let(
        ascii_lower(F.col(words)),
        lambda s: F.struct(let(parts(s), base_places).alias("base"), let(F.concat(F.lit(" "), s, F.lit(" ")), lambda p: let(detections(p), unsuppressed)).alias("found")),
    )
    rows = rows.withColumn(scan, F.when(gate, some).otherwise(none))
    base, found = F.col(scan)["base"], F.col(scan)["found"]
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform(base, lambda b: b["label"]), F.transform(found, lambda d: d["label"]))))
    best = F.greatest(F.coalesce(F.array_max(F.transform(found, lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size(base) > 0, F.lit(0.9)).otherwise(F.lit(0.0)))
    shown = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["neg_end"]).alias("end"), (-d["neg_priority"]).alias("priority"), d["confidence"].alias("confidence"), d["label"].alias("label"), d["part"].alias("words")))
    result = F.struct(count_parts(F.col(words)).alias("n_words"), base.alias("base"), shown.alias("detections"), base_labels.alias("base_labels"), labels.alias("labels"), best.alias("score"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()], result.alias(out))
