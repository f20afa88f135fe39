"""Quality rules whose cutoffs carry a guarantee on false rejections.

A rule rejects a document when one of its measures passes a cutoff. Cutoffs are chosen for each stratum
(``lang``) from labelled documents: the tuning half picks the cutoff that separates best, the held-out
half certifies it. A cutoff is certified when the exact binomial test rejects "more than ``RISK`` of the
good documents would be rejected by this rule" at ``CONFIDENCE``, divided by the number of strata, rules
and cutoffs (Bonferroni); otherwise the next weaker one is tried, and a rule without a certified cutoff
rejects nothing. All rules together then reject at most ``RISK * len(RULES)`` of the good documents of
every stratum, with the stated confidence for all strata at once.

Defined cases: a null text has no words; no labels means no cutoffs; a null language is a stratum of its
own; of several labels of a document the worst counts, null labels and labels of unknown documents don't.
Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.arrays import Texts, byte_codes, grams, range_hashes, word_hashes, words_of
from tabwright.llm.rows import map_texts, remainder
from tabwright.plans import storage

WINDOW = 5
RISK, CONFIDENCE = 0.01, 0.95
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines",
          "n_marks", "n_capitals", "n_different")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_CAPITALS = np.zeros(256, bool)
_CAPITALS[65:91] = True


@dataclass(frozen=True)
class Rule:
    name: str
    top: str
    bottom: str
    cutoffs: tuple[float, ...]

    def measure(self) -> Column:
        return F.col(self.top) / F.greatest(F.col(self.bottom), F.lit(1))


#: A document is rejected when top / bottom is above the cutoff; the strongest cutoff comes first.
RULES = (
    Rule("repeated words", "n_repeat_words", "n_words", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8)),
    Rule("repeated lines", "n_dup_lines", "n_lines", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    Rule("symbols", "n_symbols", "word_chars", (0.01, 0.02, 0.05, 0.1, 0.2, 0.4)),
    Rule("punctuation", "n_marks", "word_chars", (0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5)),
    Rule("capitals", "n_capitals", "word_chars", (0.1, 0.15, 0.2, 0.3, 0.5, 0.8)),
    Rule("long words", "word_chars", "n_words", (8.0, 10.0, 12.0, 15.0, 20.0, 40.0)),
)


def _per_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return np.diff(total[offsets])


def _first_seen(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether it is the first of its value in the row, and how often the value is there."""
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    group = np.cumsum(new) - 1
    first, times = np.empty(len(order), bool), np.empty(len(order), np.int64)
    first[order] = new
    times[order] = np.bincount(group, minlength=1)[group] if len(order) else 0
    return first, times


def count_texts(texts: Texts) -> list[np.ndarray]:
    """The counts named in ``COUNTS`` for each text."""
    data, offsets, rows = texts.data, texts.offsets, texts.rows
    words = words_of(texts)
    character = (data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(character, dtype=np.int64)])
    in_words = np.bincount(words.row, total[words.ends] - total[words.starts], minlength=rows).astype(np.int64)

    stops = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:][np.diff(offsets) > 0]]))
    begins = np.concatenate([[0], stops[:-1] + (data[stops[:-1]] == 10)]) if len(stops) else np.zeros(0, np.int64)
    place = np.searchsorted(words.starts, np.stack([begins, stops])) if len(stops) else np.zeros((2, 0), np.int64)
    worded = place[1] > place[0]
    line_row = np.searchsorted(offsets, begins, "right")[worded] - 1
    lines = range_hashes(byte_codes(data), begins[worded], stops[worded])
    new_line, _ = _first_seen(line_row, lines)

    codes = word_hashes(data, words)
    windows, first = grams(codes, words.first, WINDOW)
    window_row = np.repeat(np.arange(rows), np.diff(first))
    _, times = _first_seen(window_row, windows)
    at = np.arange(len(windows)) - first[window_row] + words.first[window_row]
    again = at[times > 1]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    repeated = np.bincount(words.row, np.cumsum(cover)[:-1] > 0, minlength=rows).astype(np.int64)
    new_word, _ = _first_seen(words.row, codes)
    return [
        words.counts, in_words, _per_row(_SYMBOLS[data], offsets),
        np.bincount(line_row[~new_line], minlength=rows), repeated, _per_row(character, offsets),
        np.bincount(line_row, minlength=rows), _per_row(_MARKS[data], offsets),
        _per_row(_CAPITALS[data], offsets), np.bincount(words.row[new_word], minlength=rows),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of each document."""
    named = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("stratum"), "text")
    result = {"doc_id": "bigint", "stratum": "string"} | {n: "bigint" for n in COUNTS}
    return map_texts(named, result, lambda: lambda texts, rows: [
        rows.column("doc_id"), rows.column("stratum"), *(c.astype(np.int64) for c in count_texts(texts))])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(at most k successes in n trials of probability p), exact; 1 from the mean on."""
    if n == 0 or k >= n * p:
        return 1.0
    log = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
           + k * math.log(p) + (n - k) * math.log1p(-p))
    term = total = 1.0
    while k > 0 and term > 1e-17:
        term *= k * (1 - p) / ((n - k + 1) * p)
        total += term
        k -= 1
    return min(1.0, math.exp(log) * total)


def certified_cutoffs(counts: DataFrame, labels: DataFrame) -> dict[str, dict[str, float]]:
    """For each stratum the certified cutoffs by rule, from counts of labelled documents."""
    worst = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    judged = counts.where(~base_failed()).join(worst, "doc_id")
    passes = [F.sum((r.measure() > c).cast("long")).alias(f"{i}_{j}")
              for i, r in enumerate(RULES) for j, c in enumerate(r.cutoffs)]
    rows = judged.groupBy("stratum", (remainder(2) == 1).alias("held"), (F.col("quality") > 0).alias("good")).agg(
        F.count("*").alias("n"), *passes).collect()
    table = {(r["stratum"], r["held"], r["good"]): r for r in rows}
    strata = sorted({r["stratum"] for r in rows})
    tests = len(strata) * sum(len(r.cutoffs) for r in RULES)
    found: dict[str, dict[str, float]] = {s: {} for s in strata}
    for stratum in strata:
        good, bad, held = (table.get((stratum, *k)) for k in ((False, True), (False, False), (True, True)))
        if not (good and bad and held):
            continue
        for i, rule in enumerate(RULES):
            gain = [bad[f"{i}_{j}"] / bad["n"] - good[f"{i}_{j}"] / good["n"] for j in range(len(rule.cutoffs))]
            best = max(range(len(gain)), key=lambda j: (gain[j], j))
            if gain[best] <= 0:
                continue
            for j in range(best, len(gain)):
                if gain[j] > 0 and tail(held[f"{i}_{j}"], held["n"], RISK) <= (1 - CONFIDENCE) / tests:
                    found[stratum][rule.name] = rule.cutoffs[j]
                    break
    return found


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of each document, base_failed, kept and rejected_by (the rules that reject it)."""
    counts = storage.written(measured(docs), "counts")
    cutoffs = certified_cutoffs(counts, labels.select("doc_id", "quality"))
    reasons = []
    for rule in RULES:
        known = [(s, c[rule.name]) for s, c in cutoffs.items() if rule.name in c]
        if known:
            limits = F.create_map(*(F.lit(x) for pair in known for x in pair))
            reasons.append(F.when(rule.measure() > F.try_element_at(limits, "stratum"), F.lit(rule.name)))
    rejected = F.concat_ws(", ", *reasons) if reasons else F.lit("")
    return counts.select(
        "doc_id", *COUNTS[:5], base_failed().alias("base_failed"),
        (~base_failed() & (rejected == "")).alias("kept"), rejected.alias("rejected_by"))
