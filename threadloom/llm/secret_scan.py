"""Secret scan with a random forest against false positives, in DataFrame functions only.

A candidate is a run of 16 or more of ``[A-Za-z0-9_+/=-]`` with a digit in it,
found in whole texts together with the word before and the word after. A
random forest over its length, character classes and transitions, dictionary
coverage, path and neighbouring words decides whether it is a secret. The
dictionary is the corpus's own: its most frequent words, counted over all texts.

Neighbours enter by what the corpus says of them, not by lists of words: how many
candidates stand beside a word (or in a path), how many of them are distinct, and a
hash of the word; and what the labelled findings say of them: the share of secrets
beside the word, drawn towards the share of all. The same holds for words after a candidate.

The forest is trained on labelled findings (``MAX_FINDINGS`` distinct ones at most, each
weighing by the logarithm of its repetitions). ``label`` makes labels from the corpus by
a rule that looks at nothing the forest sees: a candidate is a secret if it is assigned,
that is, stands in quotes after ``=`` or ``:``. ``findings_by_rule`` adds kinds that a
corpus may lack; together they weigh ``RULE_WEIGHT`` of the corpus's own. The forest is
applied as ordinary nested conditionals, one per tree.

Edge cases: null and empty texts have no candidates; null ids, paths and
neighbours are allowed; a neighbour is empty where no word stands within four
separators, where it has more than 40 letters, or where it is a candidate itself;
every repeated row and every repeated candidate is reported; an empty table gives
an empty result; without labelled findings every candidate scores 0.5 and counts
as a secret; other input columns, whatever their names, are dropped; a very long
text is searched as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import store

RUN = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
MAX_FINDINGS, DICTIONARY_WORDS = 20_000, 400
_BEFORE, _AFTER = r"(?:^|\W)(\w{1,40})\W{1,4}$", r"^\W{1,4}(\w{1,40})(?:\W|$)"
RULE_WEIGHT, PRIOR = 0.2, 5
#: Features that look at neighbours and path, not at the candidate.
NEIGHBOURS = tuple(f"{side}_{what}" for side in ("before", "after", "path") for what in ("count", "fresh", "hash", "rate")) + ("path_depth",)


def candidates(docs: DataFrame, doc_id: str, text: str, path: str | None) -> DataFrame:
    """(doc_id, no, before, candidate, after, assigned, path), one row per candidate of every text.

    One search over every text; those with a candidate are then cut at their candidates once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"))
    rows = rows.filter(F.col("text").rlike(RUN))
    found = rows.select("doc_id", "path", F.split("text", RUN, -1).alias("__between"), F.posexplode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("no", "candidate"))
    left, right = F.get("__between", F.col("no")), F.get("__between", F.col("no") + 1)
    found = found.select("doc_id", "no", "candidate", "path", F.substring(left, -48, 48).alias("__left"), F.substring(right, 1, 48).alias("__right"))
    assigned = F.col("__left").rlike(r"[=:]\s?[\"']$") & F.col("__right").rlike(r"^[\"']")
    return found.select("doc_id", "no", F.regexp_extract("__left", _BEFORE, 1).alias("before"), "candidate", F.regexp_extract("__right", _AFTER, 1).alias("after"), assigned.alias("assigned"), "path")


def label(found: DataFrame) -> DataFrame:
    """Findings labelled by the rule: assigned ones are secrets."""
    return found.withColumn("is_secret", F.col("assigned"))


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY_WORDS) -> list[str]:
    """The ``size`` most frequent words of 4 to 16 plain letters, over all texts; ties in the order of the words."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\w])[a-z]{4,16}+(?![\w])"), F.lit(0))).alias("word"))
    return [r.word for r in words.groupBy("word").count().orderBy(F.col("count").desc(), "word").limit(size).collect()]


@dataclass
class Beside:
    """What the corpus says of the words and paths beside candidates: tables (word, n, fresh, rate) by side; the rate of unknown words."""

    tables: dict[str, DataFrame]
    rate: float

    def on(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``__<side>_n``, ``__<side>_fresh`` and ``__<side>_rate`` for each side; unknown words count 0."""
        for side, table in self.tables.items():
            word = F.lower(F.coalesce(F.col(side), F.lit("")))
            rows = rows.join(table, word == F.col(f"__{side}_word"), "left").drop(f"__{side}_word")
            rows = rows.withColumn(f"__{side}_rate", F.coalesce(f"__{side}_rate", F.lit(float(self.rate))))
        return rows


def beside(found: DataFrame, labelled: DataFrame | None = None) -> Beside:
    """Counts of candidates, and shares of distinct ones, behind each neighbouring word and path of all candidates;
    with ``labelled`` findings also the share of secrets behind it, drawn towards the share of all as if by ``PRIOR`` more."""
    tables, total = {}, None
    if labelled is not None:
        total = labelled.agg(F.avg(F.col("is_secret").cast("double"))).first()[0]
    for side in ("before", "after", "path"):
        word = F.lower(F.coalesce(F.col(side), F.lit(""))).alias(f"__{side}_word")
        table = found.groupBy(word).agg(F.count(F.lit(1)).alias(f"__{side}_n"), (F.count_distinct("candidate") / F.count(F.lit(1))).alias(f"__{side}_fresh"))
        if total is None:
            table = table.withColumn(f"__{side}_rate", F.lit(None).cast("double"))
        else:
            rate = (F.sum(F.col("is_secret").cast("double")) + PRIOR * total) / (F.count("is_secret") + PRIOR)
            table = table.join(labelled.groupBy(word).agg(rate.alias(f"__{side}_rate")), f"__{side}_word", "full_outer")
        table = store.table(table, "beside")
        tables[side] = F.broadcast(table) if table.count() <= 200_000 else table.hint("merge")
    return Beside(tables, 0.5 if total is None else total)


def _share(pattern: str) -> Column:
    c = F.col("candidate")
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / F.length(c)


def features(known: list[str] = ()) -> dict[str, Column]:
    """Feature name -> expression over rows with what is :class:`Beside` them; ``known`` is the dictionary."""
    spelled = "|".join(sorted((w for w in {*known, *NAMING} if len(w) > 3), key=lambda w: (-len(w), w)))
    c, low = F.col("candidate"), F.lower("candidate")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1")
    return {
        "length": F.length(c).cast("double"),
        "digits": _share("[0-9]"),
        "uppers": _share("[A-Z]"),
        "symbols": _share("[_+/=-]"),
        "vowels": _share("(?i)[aeiou]"),
        "beyond_hex": _share("(?i)[g-z]"),
        "transitions": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / F.length(c),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(36)),
        "repeats": (F.length(c) - F.length(F.regexp_replace(c, r"(.)\1\1+", "$1"))) / F.length(c),
        "dictionary": (F.length(c) - F.length(F.regexp_replace(low, f"(?:{spelled})", ""))) / F.length(c),
        "letters_run": F.length(F.regexp_extract(c, "([A-Za-z]{5,})", 1)) / F.length(c),
        "path_depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double"),
        **{f"{side}_count": F.floor(F.log2(1 + F.coalesce(F.col(f"__{side}_n"), F.lit(0)))).cast("double") for side in ("before", "after", "path")},
        **{f"{side}_fresh": F.round(F.coalesce(F.col(f"__{side}_fresh"), F.lit(0.0)), 1) for side in ("before", "after", "path")},
        **{f"{side}_rate": F.round(f"__{side}_rate", 2) for side in ("before", "after", "path")},
        **{f"{side}_hash": F.pmod(F.xxhash64(F.lower(F.coalesce(F.col(side), F.lit("")))), F.lit(64)).cast("double") for side in ("before", "after", "path")},
    }


@dataclass
class Node:
    """A leaf (``feature`` is None) with its share of secrets, or a split."""

    value: float
    feature: str | None = None
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(float(self.value))
        return F.when(F.col(self.feature) <= self.threshold, self.low.column()).otherwise(self.high.column())

    def score(self, row: dict) -> float:
        node = self
        while node.feature is not None:
            node = node.low if row[node.feature] <= node.threshold else node.high
        return node.value


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int, least: int) -> Node:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Node(share)
    best = (1e-12, None, 0.0)
    whole = share * (1 - share)
    for f in sorted(rng.choice(len(names), size=max(2, int(np.sqrt(len(names)) + 1)), replace=False)):
        values = np.unique(x[:, f])
        cuts = (values[1:] + values[:-1]) / 2 if len(values) <= 24 else np.unique(np.quantile(values, np.linspace(0.04, 0.96, 24)))
        for t in cuts:
            left = x[:, f] <= t
            n = left.sum()
            if n < least or len(y) - n < least:
                continue
            p, q = y[left].mean(), y[~left].mean()
            gain = whole - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
            if gain > best[0]:
                best = (gain, f, float(t))
    if best[1] is None:
        return Node(share)
    left = x[:, best[1]] <= best[2]
    return Node(share, names[best[1]], best[2], _grow(x[left], y[left], names, rng, depth - 1, least), _grow(x[~left], y[~left], names, rng, depth - 1, least))


@dataclass
class Forest:
    """Trees whose mean leaf value is the score."""

    trees: list[Node]

    def column(self) -> Column:
        if not self.trees:
            return F.lit(0.5)
        total = self.trees[0].column()
        for tree in self.trees[1:]:
            total = total + tree.column()
        return total / len(self.trees)

    def score(self, row: dict) -> float:
        return sum(t.score(row) for t in self.trees) / len(self.trees) if self.trees else 0.5


def train(
    findings: DataFrame, around: Beside, known: list[str] = (), made: DataFrame | None = None, *, without: tuple[str, ...] = (), trees: int = 21, depth: int = 8, least: int = 4, seed: int = 7,
    max_findings: int = MAX_FINDINGS,
) -> Forest:
    """Fit on labelled findings (before, candidate, after, path, is_secret) and findings ``made`` by rule; ``without`` names features to leave out.

    Equal findings are one, which weighs 1 + ln(times); of more than ``max_findings`` distinct ones those are picked that a hash puts first."""
    keys = ["before", "candidate", "after", "path", "is_secret"]
    named = {n: c for n, c in features(known).items() if n not in without}

    def rows(source: DataFrame) -> np.ndarray:
        each = source.filter("is_secret is not null and candidate is not null").groupBy(*keys).agg((1 + F.ln(F.count(F.lit(1)))).alias("w"))
        few = around.on(store.pick(each, F.xxhash64(*keys[:4]), max_findings, "candidate", "before", "after", "path", "is_secret"))
        got = few.select(*[c.alias(n) for n, c in named.items()], F.col("is_secret").cast("double").alias("y"), "w").collect()
        return np.array([tuple(r) for r in got], dtype=float).reshape(len(got), len(named) + 2)

    data = rows(findings)
    if made is not None:
        extra = rows(made)
        extra[:, -1] *= RULE_WEIGHT * data[:, -1].sum() / max(1.0, extra[:, -1].sum()) if len(data) else 1.0
        data = np.concatenate([data, extra])
    if not len(data):
        return Forest([])
    order = np.lexsort(data.T)  # rows come in any order
    data = data[order]
    x, y, w, names, rng = data[:, :-2], data[:, -2], data[:, -1] / data[:, -1].sum(), list(named), np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        pick = rng.choice(len(y), size=len(y), p=w)
        out.append(_grow(x[pick], y[pick], names, rng, depth, least))
    return Forest(out)


def judge(found: DataFrame, forest: Forest, around: Beside, known: list[str] = (), *, at_least: float = 0.5) -> DataFrame:
    """``found`` with ``score`` and ``is_secret``."""
    columns = [c for c in found.columns if c not in ("score", "is_secret")]
    scored = around.on(found).select("*", *[c.alias(n) for n, c in features(known).items()]).select(*columns, F.round(forest.column(), 9).alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= at_least)


def scan(docs: DataFrame, forest: Forest, around: Beside, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", *, known: list[str] = (), at_least: float = 0.5) -> DataFrame:
    """(doc_id, no, before, candidate, after, assigned, path, score, is_secret) per candidate."""
    return judge(candidates(docs, doc_id, text, path), forest, around, known, at_least=at_least)


def held_out(found: DataFrame, known: list[str] = (), spark: SparkSession | None = None, *, without: tuple[str, ...] = ()) -> dict[str, float]:
    """Precision and recall against the rule's labels on half of the candidates, by a hash of them, trained on the other half."""
    side = F.pmod(F.xxhash64("candidate"), F.lit(2))
    learn = label(found).filter(side == 0).select("before", "candidate", "after", "path", "is_secret")
    around = beside(learn, learn)
    forest = train(learn, around, known, None if spark is None else findings_by_rule(spark), without=without)
    fresh = label(found).filter(side == 1).withColumnRenamed("is_secret", "wanted")
    n = judge(fresh, forest, around, known).agg(*[F.count(F.when(F.col("is_secret") == x, F.when(F.col("wanted") == y, 1))).alias(f"{a}{b}") for a, x in (("p", True), ("n", False)) for b, y in (("t", True), ("f", False))]).first()
    return {"secrets": n.pt + n.nt, "others": n.pf + n.nf, "precision": n.pt / max(1, n.pt + n.pf), "recall": n.pt / max(1, n.pt + n.nt)}


#: Words of the findings made by rule.
NAMING = (
    "account address alpha article branch buffer build cache channel client column config content customer data default document error event example filter "
    "group header history image index invoice label layer length level line list location manager message method model module name network note number "
    "order page parent path process product project query record region release report request resource response result sample schema section server "
    "service session source status string style summary system table target task template text theme ticket time title total type user value version view"
).split()


def findings_by_rule(spark: SparkSession, n: int = 4000, seed: int = 11) -> DataFrame:
    """Labelled findings made by rule, half of them secrets: random keys beside naming words against
    numbers, digests and identifiers of ordinary text, placeholders and test values."""
    def pick(tag: str, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(f"{tag}{seed}")), F.lit(len(values))) + 1).cast("int"))

    digest = F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"x{seed}")), 512)
    more = F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"y{seed}")), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "[\r\n]", "")
    size = (F.pmod(F.xxhash64("id", F.lit(f"n{seed}")), F.lit(25)) + 20).cast("int")
    digits = F.translate(more, "abcdef", "012345")
    words = F.concat_ws("_", *[pick(f"w{i}", NAMING) for i in range(3)], F.substring(digits, 1, 2))
    kind = F.pmod("id", F.lit(12))
    secret = (
        F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, F.upper(F.substring(digest, 1, 40)))
        .when(kind == 2, F.substring(base64, F.lit(1), size)).when(kind == 3, F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))))
        .when(kind == 4, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(base64, "[+/=]", "a"), 1, 36)))
        .when(kind == 5, F.substring(digest, F.lit(1), size))
    )
    plain = (
        F.when(kind == 6, F.substring(digits, 1, 16)).when(kind == 7, words)
        .when(kind == 8, F.concat(F.lit("xxxxxxxxxxxxxxxxxxxx"), F.substring(digits, 1, 1)))
        .when(kind == 9, F.concat_ws("-", F.substring(more, 1, 8), F.substring(more, 9, 4), F.substring(more, 13, 4), F.substring(more, 17, 12)))
        .when(kind == 10, F.substring(more, 1, 40)).when(kind == 11, F.concat(pick("a", NAMING), pick("b", NAMING), pick("c", NAMING), F.lit("1234")))
    )
    good = pick("g", ["token", "api_key", "secret", "password", "auth", "TOKEN", "access_key", "client_secret"])
    bare = pick("h", ["the", "value", "with", "that", "la", "der", "", "de"])
    flat = pick("p", ["commit", "sha256", "md5", "uuid", "digest", "revision", "checksum", "etag"])
    before = F.when(kind < 6, good).when(kind.isin(9, 10), flat).when(kind == 7, pick("k", ["name", "path", "the", "see", "token"])).otherwise(bare)
    path = pick("f", ["src/main", "config/app", "src0", "src5", "notes", "deploy/values"])
    return spark.range(n).select(
        before.alias("before"), F.coalesce(secret, plain).alias("candidate"), pick("t", ["the", "and", "", "le", "in", "THE"]).alias("after"),
        path.alias("path"), (kind < 6).alias("is_secret"),
    )
