"""Quality rules: an ordered list of threshold rules, learned from labelled text statistics.

Each text is reduced to counts in one pass over its bytes. Sequential covering then learns
rules that reject: a rule grows by the threshold that gains most on two thirds of the rows,
is cut back on the last third, and the rows it covers leave before the next rule is grown.
The list becomes one Spark conditional expression over the counts, so that judging needs no
Python and no shuffle.

Defined results: a null or empty text has no words and fails the base rule; equal rows get
equal verdicts; rows without a label, or whose label is neither 0 nor 1, teach nothing; without
labelled rows of both kinds there are no learned rules and only the base rule rejects. Columns
besides `doc_id` and `text` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.memory import lean
from kartoteka.llm.spans import byte_table, mix, slices

TRAINING_ROWS = 10_000  # labelled rows that the rules are learned from, at most
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
MIN_PRECISION = 0.9
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 3, 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words")
_SYMBOLS = byte_table("#*$%&|<>")
_UPPER = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = byte_table("0123456789")
_MARKS = byte_table("!?")

# Name of a ratio, its dividend and its divisor; thresholds are on ratios, so that they hold for texts of any length.
RATIOS = (
    ("word_length", "word_chars", "n_words"), ("symbols", "n_symbols", "n_words"), ("repeated", "n_repeat_words", "n_words"),
    ("dup_lines", "n_dup_lines", "n_lines"), ("upper", "n_upper", "word_chars"), ("digits", "n_digits", "word_chars"),
    ("marks", "n_marks", "n_words"), ("distinct", "n_distinct_words", "n_words"),
)


def _repeats(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether the same owner has it elsewhere; 2 marks the first of equal ones."""
    keys = mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    before = np.concatenate([[False], same])
    after = np.concatenate([same, [False]])
    out = np.zeros(len(keys), np.int8)
    out[order] = np.where(before, 1, np.where(after, 2, 0))
    return out


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a column."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in COUNTS}
    for texts in slices(column):
        data, n = texts.data, len(texts)
        bounds, owner = texts.word_bounds, texts.word_owner
        starts = texts.words[0]
        in_word = texts._in_word

        line_starts, line_ends = texts.cut_after(np.flatnonzero(data == 10) + 1)
        body = line_ends - ((line_ends > line_starts) & (data[line_ends - 1] == 10)) if len(line_ends) else line_ends
        filled = np.searchsorted(starts, line_starts) < np.searchsorted(starts, body)
        line_starts, body = line_starts[filled], body[filled]
        line_owner = np.searchsorted(texts.offsets, line_starts, "right") - 1
        repeated_line = _repeats(line_owner, texts.hashes(line_starts, body)) == 1

        first, hashes = texts.windows(WINDOW)
        found = first[_repeats(owner[first], hashes) > 0]
        edges = np.bincount(found, minlength=len(starts) + 1) - np.bincount(found + WINDOW, minlength=len(starts) + 1)
        covered = np.cumsum(edges[:-1]) > 0

        by_owner = lambda who: np.bincount(who, minlength=n).astype(np.int64)
        for name, values in (
            ("n_words", np.diff(bounds)),
            ("word_chars", texts.per_text(in_word & ((data & 0xC0) != 0x80))),
            ("n_symbols", texts.per_text(_SYMBOLS[data])),
            ("n_dup_lines", by_owner(line_owner[repeated_line])),
            ("n_repeat_words", by_owner(owner[covered])),
            ("n_lines", by_owner(line_owner)),
            ("n_upper", texts.per_text(_UPPER[data])),
            ("n_digits", texts.per_text(_DIGITS[data])),
            ("n_marks", texts.per_text(_MARKS[data])),
            ("n_distinct_words", by_owner(owner[_repeats(owner, texts.word_hashes) != 1])),
        ):
            parts[name].append(values)
    return {name: np.concatenate(values) if values else np.zeros(0, np.int64) for name, values in parts.items()}


def text_counts(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and the counts of each row's text; a kept column may be the text itself."""
    keep = list(keep)
    names = [f"kept_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names, strict=True)],
                       *[] if "text" in keep else [F.col("text").alias("whole_text")])
    text = names[keep.index("text")] if "text" in keep else "whole_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_texts(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(a) for a in names] + [pa.array(counts[c], pa.int64()) for c in COUNTS], names + list(COUNTS))

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names]
    return rows.mapInArrow(lean(run), ", ".join(fields + [f"{c} long" for c in COUNTS]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """A ratio at most, or over, a threshold."""

    ratio: int
    over: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.ratio] > self.threshold if self.over else x[:, self.ratio] <= self.threshold

    def column(self) -> Column:
        _, dividend, divisor = RATIOS[self.ratio]
        value = F.col(dividend) / F.greatest(F.col(divisor), F.lit(1))
        return value > self.threshold if self.over else value <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition with the largest information gain until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for ratio in range(x.shape[1]):
            values = x[inside, ratio]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS), method="lower"))
            at = np.searchsorted(cuts, values)  # values equal to a cut are at most it
            bad_to = np.cumsum(np.bincount(at[bad[inside]], minlength=len(cuts)))
            all_to = np.cumsum(np.bincount(at, minlength=len(cuts)))
            for over, pos, every in ((False, bad_to, all_to), (True, p - bad_to, p + n - all_to)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = pos * (np.log2(pos / every) - np.log2(p / (p + n)))
                g = np.nan_to_num(g, nan=-1, posinf=-1, neginf=-1)
                k = int(np.argmax(g))
                if g[k] > gain:
                    upper = cuts[k + 1] if k + 1 < len(cuts) else cuts[k]
                    best, gain = Condition(ratio, over, float((cuts[k] + upper) / 2)), g[k]
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop last conditions as long as the rule does better on rows it was not grown on."""
    def value(r: Rule) -> float:
        hit = _covered(r, x)
        p = (hit & bad).sum()
        return (2 * p - hit.sum()) / max(1, hit.sum()) if hit.any() else -1.0

    best = rule
    for size in range(len(rule) - 1, 0, -1):
        if value(rule[:size]) >= value(best):
            best = rule[:size]
    return best


def learn_rules(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """An ordered list of rules that reject; each is right for `MIN_PRECISION` of what it newly covers."""
    third = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and bad[left].any() and not bad[left].all():
        grow, prune = left & ~third, left & third
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _prune(_grow(x[grow], bad[grow]), x[prune], bad[prune])
        hit = _covered(rule, x) & left
        if not rule or hit.sum() < 5 or bad[hit].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learned_rules(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> list[Rule]:
    """Rules from at most `limit` labelled rows, those with the smallest hash of their id."""
    chosen = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    counts = text_counts(labelled).withColumnRenamed("kept_0", "doc_id")
    rows = (counts.join(F.broadcast(chosen), "doc_id").where(~base_failed())
            .orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(2 * limit).toPandas())
    if not len(rows):
        return []
    x = np.stack([rows[a].to_numpy(float) / np.maximum(rows[b].to_numpy(float), 1) for _, a, b in RATIOS], axis=1)
    return learn_rules(x, rows["label"].to_numpy() == 0)


def verdict(rules: Sequence[Rule]) -> Column:
    """False if the base rule or a learned one rejects; the first rule that holds decides."""
    out = F.when(base_failed(), False)
    for rule in rules:
        condition = rule[0].column()
        for more in rule[1:]:
            condition = condition & more.column()
        out = out.when(condition, False)
    return out.otherwise(True)


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, `base_failed` and `kept` of every row."""
    rules = learned_rules(docs, labels)
    return text_counts(docs).withColumnRenamed("kept_0", "doc_id").withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns."""
    rules = learned_rules(docs, labels)
    judged = text_counts(docs, docs.columns).where(verdict(rules))
    return judged.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)])
