"""Quality rules: a learned decision list over text statistics.

``text_statistics`` computes per-text statistics in an Arrow function, whole texts
at a time, from which only numbers return. ``learn``
fits ordered threshold conjunctions by sequential covering on labelled
statistics: each rule is grown on one part of the rows by information gain and
pruned on the other part. ``DecisionList.verdict`` emits the ordered rules as
one nested Spark conditional, so applying the list stays in the JVM.

Edge cases: a null or empty text has all statistics 0 and fails the base rule;
null labels and labels without a document are not used (the latter still count
towards the bound); equal scores prefer the
earlier statistic and the lower threshold; no labelled rows give an empty list,
which keeps all that passes the base rule; columns of the input that clash with
a statistic's name are replaced; repeated rows are judged alike; an empty table
gives an empty result; a very long text is measured as a whole, in some forty
times its bytes of one worker's memory. Lines and windows count as equal by
their bytes, not by a hash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import store
from threadloom.llm.words import first_equal, joined, mix, slices, span_hashes, tokenize, window_hashes, window_ok

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = [*BASE, "n_lines", "n_upper", "n_marks"]
#: Labelled rows that a list is fitted on at most.
MAX_LABELLED = 20_000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "!?"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_WINDOW = 5


def statistics_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """All statistics of each text, in whole texts."""
    words = tokenize(texts)
    data, n_docs, of = words.data, len(words.first) - 1, words.of()
    offsets = np.zeros(n_docs + 1, dtype=np.int64)
    lengths = pa.compute.binary_length(texts.cast(pa.large_string())).fill_null(0)
    np.cumsum(np.asarray(lengths, dtype=np.int64), out=offsets[1:])

    def per_doc(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flag) + 1, dtype=np.int64)
        np.cumsum(flag, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    newline = data == 10
    out = {"n_words": words.counts, "n_symbols": per_doc(_SYMBOL[data]), "n_upper": per_doc(_UPPER[data]), "n_marks": per_doc(_MARK[data])}
    separator = newline | (data == 32) | ((data >= 9) & (data <= 13))
    out["word_chars"] = per_doc(((data & 0xC0) != 0x80) & ~separator)

    cut = np.flatnonzero(newline)
    start = np.unique(np.concatenate([offsets[:-1][lengths.to_numpy() > 0], cut + 1, np.zeros(0, np.int64)]))
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(data)), offsets[doc + 1])
    end = end - ((end > start) & newline[np.maximum(end, 1) - 1]) if len(end) else end
    holds = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[holds], end[holds], doc[holds]
    line = first_equal(mix(span_hashes(data, start, end) ^ mix(doc.astype(np.uint64) + np.uint64(1))), data, start, end, doc)
    again = line != np.arange(len(line))
    out["n_lines"] = np.bincount(doc, minlength=n_docs)
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n_docs)

    windows = np.flatnonzero(window_ok(words, _WINDOW))
    key = mix(window_hashes(words.hashes(), _WINDOW)[windows] ^ mix(of[windows].astype(np.uint64) + np.uint64(1)))
    plain, begin, until = joined(words)
    window = first_equal(key, plain, begin[windows], until[windows + _WINDOW - 1], of[windows])
    twice = windows[np.bincount(window, minlength=1)[window] > 1]
    edge = np.zeros(len(of) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + _WINDOW, -1)
    out["n_repeat_words"] = np.bincount(of[np.cumsum(edge[:-1]) > 0], minlength=n_docs)
    return {k: np.asarray(v, dtype=np.int64) for k, v in out.items()}


def _measured(texts: pa.Array) -> pa.Array:
    """A struct of all statistics for each text, made in parts of bounded size."""
    parts = [statistics_of(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64)) for c in STATISTICS], STATISTICS)


def text_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns in ``keep``, else all) with one long column per statistic of ``text``.

    Texts go to Python once and only numbers come back: the other columns stay in the JVM."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in STATISTICS]
    measure = F.arrow_udf(_measured, T.StructType([T.StructField(c, T.LongType()) for c in STATISTICS]))
    found = df.select(*keep, measure(F.col(text).cast("string")).alias("__tl_found"))
    return found.select(*keep, *[F.col("__tl_found")[c].alias(c) for c in STATISTICS])


def base_failed() -> Column:
    """The fixed rule: too few words, or too many words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Features that rules test: name -> (numerator, denominator or None).
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
}


def feature(name: str) -> Column:
    top, under = FEATURES[name]
    return F.col(top).cast("double") if under is None else F.col(top).cast("double") / F.greatest(F.col(under), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Test:
    """One threshold test of a rule."""

    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return feature(self.feature) >= F.lit(self.threshold) if self.above else feature(self.feature) <= F.lit(self.threshold)


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds rejects, otherwise a row is kept."""

    rules: list[list[Test]] = field(default_factory=list)

    def verdict(self) -> Column:
        """True for rows that the list keeps."""
        out = None
        for rule in self.rules:
            all_hold = rule[0].column()
            for test in rule[1:]:
                all_hold = all_hold & test.column()
            out = F.when(all_hold, F.lit(False)) if out is None else out.when(all_hold, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def rule_number(self) -> Column:
        """The 1-based number of the rule that rejects a row, else null."""
        out = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            hold = self.rules[i - 1][0].column()
            for test in self.rules[i - 1][1:]:
                hold = hold & test.column()
            out = F.when(hold, F.lit(i)).otherwise(out)
        return out

    def describe(self) -> list[str]:
        return [" and ".join(f"{t.feature} {'>=' if t.above else '<='} {t.threshold:.6g}" for t in r) for r in self.rules]


def features_of(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: rows[a].astype(float) / (np.maximum(rows[b], 1).astype(float) if b else 1.0) for k, (a, b) in FEATURES.items()}


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_tests: int = 3, cuts: int = 48, precision: float = 0.97, support: int = 3) -> DecisionList:
    """Sequential covering. ``bad`` marks the rows to reject; a rule stays if ``precision`` of the rows that it
    covers in the pruning part are bad and ``support`` of them at least."""
    x, bad = features_of(rows), np.asarray(bad, dtype=bool)
    left, out = np.ones(len(bad), dtype=bool), DecisionList()
    hold_out = np.arange(len(bad)) % 3 == 2
    # thresholds: quantiles of the good and of the bad rows, extremes included
    levels = np.linspace(0, 1, cuts)
    edges = {k: np.unique(np.concatenate([np.quantile(v[m], levels) for m in (bad, ~bad) if m.any()] or [np.zeros(0)])) for k, v in x.items()}
    while len(out.rules) < max_rules and (left & bad).any():
        grow, rule = left & ~hold_out, []
        covered = grow.copy()
        for _ in range(max_tests):
            p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
            if p0 == 0 or n0 == 0:
                break
            best, gain = None, 1e-9
            for name in FEATURES:
                for at in edges[name]:
                    for above in (True, False):
                        hit = covered & Test(name, above, float(at)).holds(x)
                        p, n = (hit & bad).sum(), (hit & ~bad).sum()
                        if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = Test(name, above, float(at)), g
            if best is None:
                break
            rule.append(best)
            covered &= best.holds(x)
        prune = left & hold_out
        worth, kept = -1.0, []
        for n_tests in range(1, len(rule) + 1):
            hit = prune.copy()
            for test in rule[:n_tests]:
                hit &= test.holds(x)
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            if p + n and (w := (p - n) / (p + n)) > worth:
                worth, kept, counts = w, rule[:n_tests], (p, n)
        if not kept or counts[0] < support or counts[0] < precision * sum(counts):
            break
        out.rules.append(kept)
        hit = left.copy()
        for test in kept:
            hit &= test.holds(x)
        left &= ~hit
    return out


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Fit on the texts of labelled rows (label 0: bad, 1: good), ``max_labelled`` of them at most, picked by a hash of the key.

    Only these texts are measured. A key with both labels counts as bad; of rows with one key the smallest statistics count."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__tl_key")).agg(F.min(label).alias("__tl_label"))
    marks = store.pick(marks, F.xxhash64("__tl_key"), max_labelled, "__tl_key")
    # at most max_labelled keys and labels: the one thing that is broadcast, and as many rows reach the driver
    rows = docs.select(key, text).join(F.broadcast(marks), F.col(key) == F.col("__tl_key"))
    found = text_statistics(rows, text, keep=["__tl_key", "__tl_label"]).groupBy("__tl_key", "__tl_label").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    rows = found.select("__tl_key", "__tl_label", "s.*").toPandas()
    rows = rows.assign(turn=_turn(rows["__tl_key"])).sort_values(["turn", "__tl_key"])
    return learn({c: rows[c].to_numpy() for c in STATISTICS}, rows["__tl_label"].to_numpy() == 0)


def _turn(keys) -> np.ndarray:
    """An order of keys that has nothing to do with their values: it decides which rows prune."""
    return np.array([int.from_bytes(hashlib.blake2b(repr(k).encode(), digest_size=8).digest(), "little") for k in keys], dtype=np.uint64)


def judge(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    """Add ``base_failed``, ``rule`` (number of the rejecting rule, null for none) and ``kept``."""
    return statistics.withColumns({"base_failed": base_failed(), "rule": rules.rule_number()}).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.verdict())
    )


def kept(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rule and the list keep, with all their columns, whatever their names."""
    whole = docs.select(F.struct("*").alias("__tl_row"), F.col(text).alias("__tl_text"))
    return judge(text_statistics(whole, "__tl_text", keep=["__tl_row"]), rules).filter("kept").select("__tl_row.*")
