"""Quality rules: text statistics, fixed base rules, and a learned decision list.

Statistics come from one vectorised pass over the texts. The decision list is learned by
sequential covering from labelled statistics: a rule grows by the threshold that gains most,
is pruned on rows it has not seen, and is kept if it is precise enough there; the rows it covers
leave and the next rule is grown. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .arrow_text import LEAD, SPACE, Words, counts_between, first_of_runs, mix64, slices, utf8
from .runtime import small_batches

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
CALLS = np.zeros(256, dtype=bool)
CALLS[list(b"!?")] = True
DIGITS = np.zeros(256, dtype=bool)
DIGITS[48:58] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_calls", "n_digits", "n_distinct_words")


def repeated_window_words(words: Words, width: int = 5) -> np.ndarray:
    """For each text, the words in ``width``-word windows that the text holds twice or more."""
    n = len(words)
    out = np.zeros(len(words.bounds) - 1, dtype=np.int64)
    if n < width:
        return out
    ids, texts = words.ids, words.texts
    key = mix64(texts[: n - width + 1].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(width):
        key = mix64(key * np.uint64(0x2545F4914F6CDD1D) + ids[k : n - width + 1 + k].astype(np.uint64))
    whole = np.flatnonzero(texts[: n - width + 1] == texts[width - 1 :])
    order = np.argsort(key[whole], kind="stable")
    sorted_keys = key[whole][order]
    first = first_of_runs(sorted_keys)
    same = ~first
    same[:-1] |= ~first[1:]
    starts = whole[order[same]]
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return counts_between(np.cumsum(change[:-1]) > 0, words.bounds)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text (lines, lines with a word that equal an earlier line)."""
    n_texts = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets))
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    text_of = np.repeat(np.arange(n_texts), per_text + 1)
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~SPACE[data], out=inside[1:])
    full = np.flatnonzero(inside[ends] > inside[begins])
    if not len(full):
        return per_text + 1, np.zeros(n_texts, dtype=np.int64)
    # A line with its break is a slice of the buffer; without breaks the lines are packed end to end.
    kept = data[data != 10]
    sizes = ends - begins
    line_offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=line_offsets[1:])
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(line_offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.sort(text_of[full] * (int(ids.max()) + 1) + ids[full])
    again = keys[~first_of_runs(keys)] // (int(ids.max()) + 1)
    return per_text + 1, np.bincount(again, minlength=n_texts)


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts named in ``COUNTS`` for each text of a column."""
    data, offsets = utf8(column)
    words = Words(data, offsets)
    n_lines, n_dup = duplicate_lines(data, offsets)
    texts, ids = words.texts, words.ids if len(words) else np.zeros(0, np.int64)
    pairs = np.sort(texts * (int(ids.max()) + 1 if len(ids) else 1) + ids)
    distinct = np.bincount(pairs[first_of_runs(pairs)] // (int(ids.max()) + 1), minlength=len(offsets) - 1) if len(ids) else np.zeros(len(offsets) - 1, np.int64)
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": counts_between(LEAD[data] & ~SPACE[data], offsets),
        "n_symbols": counts_between(SYMBOLS[data], offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated_window_words(words),
        "n_lines": n_lines,
        "n_upper": counts_between(UPPER[data], offsets),
        "n_calls": counts_between(CALLS[data], offsets),
        "n_digits": counts_between(DIGITS[data], offsets),
        "n_distinct_words": distinct,
    }


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            counts = text_counts(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS]], ["doc_id", *COUNTS])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts of each whole text; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_count_batches, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """The interpretable ratios over which rules are learned."""

    def per(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "upper_share": per("n_upper", "word_chars"),
        "calls_per_word": per("n_calls", "n_words"),
        "digit_share": per("n_digits", "word_chars"),
        "distinct_word_share": per("n_distinct_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, cols: dict[str, Column]) -> Column:
        return cols[self.feature] >= F.lit(self.threshold) if self.above else cols[self.feature] <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.mask(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, thresholds: int, most: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and bad[inside].any() and not bad[inside].all():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best, best_gain = None, 1e-9
        for name, values in x.items():
            cuts = np.unique(np.quantile(values[inside & bad], np.linspace(0, 1, thresholds)))
            for t in cuts:
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    m = inside & c.mask(x)
                    p, n = int((m & bad).sum()), int((m & ~bad).sum())
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                    if gain > best_gain:
                        best, best_gain = c, gain
        if best is None:
            break
        rule.append(best)
        inside &= best.mask(x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    m = covers(rule, x)
    p, n = int((m & bad).sum()), int((m & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, max_rules: int = 12, max_conditions: int = 3, thresholds: int = 24, least: int = 5) -> list[Rule]:
    """An ordered list of rules for the rows where ``bad`` holds; two thirds grow rules, one third prunes them."""
    names = sorted(x)
    x = {k: np.asarray(x[k], dtype=float) for k in names}
    prune = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow_rows, prune_rows = left & ~prune, left & prune
        if (bad & grow_rows).sum() < least:
            break
        rule = _grow({k: v[grow_rows] for k, v in x.items()}, bad[grow_rows], thresholds, max_conditions)
        held = {k: v[prune_rows] for k, v in x.items()}
        while len(rule) > 1 and _worth(rule[:-1], held, bad[prune_rows]) >= _worth(rule, held, bad[prune_rows]):
            rule = rule[:-1]
        inside = covers(rule, x) & left
        ok = [(int((inside & rows & bad).sum()), int((inside & rows).sum())) for rows in (grow_rows, prune_rows)]
        if not rule or ok[0][0] < least or any(p < precision * n for p, n in ok):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def decision(rules: Sequence[Rule], cols: dict[str, Column]) -> Column:
    """The number of the first rule that holds, from 1; 0 where none does."""
    out = F
    for i, rule in enumerate(rules):
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column(cols)
        out = out.when(cond, F.lit(i + 1))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, those with the smallest digests: the documented bound of the training."""
    return (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "label")
        .limit(rows)
    )


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 20_000,
    precision: float = 0.97,
) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``rule`` (0: none) and ``kept``.

    A document fails the base rules with fewer than 10 words, or if more than 20 % of its words
    are in repeated 5-word windows; else the first learned rule that holds rejects it. Rules are
    learned from at most ``sample_rows`` labelled documents (label 0 is bad). Defined cases: a
    null or empty text has no words and fails; without usable labels only the base rules act;
    labels of unknown or null ids are ignored; repeated rows are judged each on its own; an
    empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    stats = cut(text_statistics(docs, id_col, text_col))
    sample = labelled_sample(labels, "doc_id", label_col, sample_rows)
    cols = features()
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # The sample has at most sample_rows ids: the bound for the broadcast. One row for each label.
    train = (
        stats.join(F.broadcast(sample), "doc_id")
        .where(~base_failed)
        .groupBy("doc_id", "label")
        .agg(*[F.max(c).alias(c) for c in COUNTS])
        .select("doc_id", "label", *[c.alias(f"x_{k}") for k, c in cols.items()])
        .orderBy(F.md5(F.col("doc_id").cast("string")), "label")
        .toArrow()
    )
    rules = learn_rules({k: train.column(f"x_{k}").to_numpy() for k in cols}, train.column("label").to_numpy() == 0, precision) if train.num_rows else []
    return stats.withColumn("base_failed", base_failed).withColumn("rule", decision(rules, cols)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
