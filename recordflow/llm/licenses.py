"""Licence scan: ordered signature rules over the words of whole texts.

Words are runs of digits, letters a-z and characters beyond ASCII, in lower case. A rule is tried only in texts
with its keyword; texts without any of a few gates are done before that. Detections are ordered by start, the longer and
then the lower priority number first, and swept once: one inside the last that was kept is left out; of two that overlap
the one with the lower priority number stays, the first of equals. The base phrases are counted apart
and always give their labels.

NULL texts count as empty; repeated rows are scanned one by one; an empty table gives an empty result. Only
built-in functions run, in one pass without a shuffle. A text with d detections of a rule takes two passes of its pattern
and d log d steps, so texts of any length are scanned whole.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.license_rules import GATES, rules

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE = f"(?<= )(?:{'|'.join(BASE)})(?= )"


def normal_text(text: Column) -> Column:
    """Blank, then every word with a blank behind it; one blank without words."""
    joined = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _SEPARATORS, " "))
    return F.when(joined == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def _n_words(padded: Column) -> Column:
    return (F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit(""))) - 1).cast("long")


def gate_pattern() -> str:
    """One pattern for all gates and base phrases, by their first letter, so that most words are passed over by one look."""
    tails: dict[str, list[str]] = {}
    for gate in [*GATES, *(f" {phrase}" for phrase in BASE)]:
        tails.setdefault(gate[1], []).append(re.escape(gate[2:]))
    return " (?:" + "|".join(f"{first}(?:{'|'.join(found)})" for first, found in sorted(tails.items())) + ")"


RULE = "array<struct<keyword: string, pattern: string, label: string, priority: int, weight: double>>"


def _rule_table() -> Column:
    """All rules as one constant."""
    rows = [{"keyword": " " + r.keyword, "pattern": f"(?<= )(?:{r.pattern})(?= )", "label": r.label, "priority": r.priority, "weight": r.weight} for r in rules()]
    return F.from_json(F.lit(json.dumps(rows)), RULE)


def _running(sizes: Column) -> Column:
    """Sums of an array up to each place, by doubling the reach of each entry."""
    def doubled(sums: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.when(i >= reach, F.get(sums, i - reach)).otherwise(0))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(rounds, sizes, doubled)


def _detections(norm: Column, rule: Column) -> Column:
    """Intervals of one rule's matches, from the lengths of what stands between and in them."""
    gaps = F.transform(F.split(norm, rule["pattern"], -1), F.length)
    found = F.transform(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), F.length)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, size: F.struct((gap + size).alias("step"), size.alias("size")))
    stops = _running(F.transform(steps, lambda s: s["step"]))

    def interval(size: Column, stop: Column) -> Column:
        return F.struct((stop - size).alias("start"), (-stop).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"))

    return F.zip_with(F.transform(steps, lambda s: s["size"]), stops, interval)


_SWEEP = "struct<labels: array<string>, weight: double, stop: int, priority: int, label: string, own: double>"


def _resolved(found: Column) -> Column:
    """``(labels, weight)`` of the detections that stay; the last one kept is held back, as the next may take its place."""
    def state(labels: Column, weight: Column, d: Column) -> Column:
        return F.struct(labels.alias("labels"), weight.alias("weight"), (-d["back"]).alias("stop"), d["priority"].alias("priority"),
                        d["label"].alias("label"), d["weight"].alias("own")).cast(_SWEEP)

    def counted(s: Column) -> tuple[Column, Column]:
        new = s["label"].isNotNull() & ~F.array_contains(s["labels"], F.coalesce(s["label"], F.lit("")))
        return F.when(new, F.array_append(s["labels"], s["label"])).otherwise(s["labels"]), F.greatest(s["weight"], F.coalesce(s["own"], F.lit(0.0)))

    def step(s: Column, d: Column) -> Column:
        inside, overlaps = -d["back"] <= s["stop"], d["start"] < s["stop"]
        replaced = F.when(d["priority"] < s["priority"], state(s["labels"], s["weight"], d)).otherwise(s)
        return F.when(inside, s).when(overlaps, replaced).otherwise(state(*counted(s), d))

    start = F.from_json(F.lit('{"labels": [], "weight": 0.0, "stop": -1, "priority": 0}'), _SWEEP)

    def end(s: Column) -> Column:
        labels, weight = counted(s)
        return F.struct(labels.alias("labels"), weight.alias("weight"))

    return F.aggregate(F.array_sort(found), start, step, end)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with word, phrase and label columns of each whole text."""
    keep = [c for c in (keep or docs.columns) if c.lower() not in RESULTS]
    kept = [F.col(f"`{c}`") for c in keep]
    table = docs.select(*kept, normal_text(F.col(f"`{text}`")).alias("__norm"))
    norm = F.col("__norm")
    table = table.select(*kept, norm, _n_words(norm).alias("n_words"), norm.rlike(gate_pattern()).alias("__some"))
    some = F.col("__some")
    gaps, phrases = F.split(norm, _BASE, -1), F.regexp_extract_all(norm, F.lit(_BASE), F.lit(0))
    table = table.withColumn("__phrases", F.when(some, phrases).otherwise(F.array().cast("array<string>")))
    hit = F.size("__phrases") > 0
    first = _n_words(F.element_at(gaps, 1))
    last = F.col("n_words") - _n_words(F.element_at(gaps, -1)) - _words_of(F.element_at("__phrases", -1))
    base = F.array_sort(F.array_distinct(F.transform("__phrases", _base_label)))
    open_rules = F.filter(_rule_table(), lambda r: F.contains(norm, r["keyword"]))
    found = F.flatten(F.transform(open_rules, lambda r: _detections(norm, r)))
    table = table.select(
        *kept, "n_words", F.size("__phrases").cast("long").alias("n_base"), F.when(hit, first).alias("first_word"),
        F.when(hit, last).alias("last_word"), base.alias("__base"), F.when(some, found).alias("__found"),
    )
    table = table.withColumn("__kept", F.when(F.size("__found") > 0, _resolved(F.col("__found"))))
    own = F.coalesce("__kept.labels", F.array().cast("array<string>"))
    return table.select(
        *kept, "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("__base"), own))), ",").alias("labels"),
        F.greatest(F.coalesce("__kept.weight", F.lit(0.0)), F.when(F.size("__base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def _words_of(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def _base_label(phrase: Column) -> Column:
    label = F.lit(None).cast("string")
    for words, name in BASE.items():
        label = F.when(phrase == words, F.lit(name)).otherwise(label)
    return label
