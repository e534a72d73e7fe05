"""Operator 1: quality rules. Statistics of texts and a decision list learned from labelled ones, all DataFrame expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.llm.common import table

#: Labelled rows that the list is learned from, at most: those with the smallest hash of their id. They are the only
#: rows that reach the driver (a dozen numbers each).
SAMPLE_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 48
#: A rule must be right on this share of the pruning rows that it covers, and cover so many there.
MIN_PRECISION, MIN_COVER = 0.9, 5

SPACE = "[ \\t\\n\\u000B\\f\\r]"
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "shout_ratio", "mark_ratio")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, use) -> Column:
    """use(value) with ``value`` computed once, bound as a lambda variable."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in ``words`` (an array column), the first one included."""

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda a, b: F.get(p, a)["x"] == F.get(p, b)["x"]
            twice = F.filter(p, lambda e, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda e: e["i"]))

        step = lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["upto"])).alias("n"), (i + 3).alias("upto"))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
        return let(placed, lambda p: F.aggregate(starts(p), zero, step, lambda a: a["n"]))

    def any_twice(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) == F.get(s, i - 1)))

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, lambda h: F.when(any_twice(h), covered(h)).otherwise(F.lit(0))))

    return let(words, count).cast("long")


def statistics(text: Column) -> Column:
    """Struct of the counts of a text (null counts as empty) from which the ratios follow."""
    body = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(body, SPACE + "+"), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t\\n\\u000B\\f\\r]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.regexp_count(body, F.lit("[A-Z][A-Z]")).cast("long").alias("n_shouts"),
            F.regexp_count(body, F.lit("[!?]{2}")).cast("long").alias("n_marks"),
        )

    return let(words, counts)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, the ratios of FEATURES and base_failed. Columns of these names are replaced."""
    own = {*BASE, *FEATURES, "base_failed", "_s"}
    kept = [c for c in docs.columns if c not in own or c == text]
    s = docs.select(*kept, statistics(F.col(text)).alias("_s"))
    per_word = lambda c: F.col(c).cast("double") / F.greatest(F.col("_s.n_words"), F.lit(1))
    out = s.select(
        *kept, "_s.n_words", "_s.word_chars", "_s.n_symbols", F.col("_s.lines.n_dup_lines").alias("n_dup_lines"), "_s.n_repeat_words",
        per_word("_s.word_chars").alias("mean_word"), per_word("_s.n_symbols").alias("symbol_ratio"),
        (F.col("_s.lines.n_dup_lines").cast("double") / F.greatest(F.col("_s.lines.n_lines"), F.lit(1))).alias("dup_line_ratio"),
        per_word("_s.n_repeat_words").alias("repeat_ratio"), per_word("_s.n_shouts").alias("shout_ratio"), per_word("_s.n_marks").alias("mark_ratio"),
    )
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


# ---------------------------------------------------------------- learning

@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.threshold) == self.at_least

    def column(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c >= F.lit(self.threshold) if self.at_least else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """If all conditions hold, the text is rejected."""

    conditions: tuple[Condition, ...]

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.conditions))


def cut_points(values: list[float], most: int = CUTS) -> list[float]:
    """Midpoints between neighbouring distinct values, thinned to about ``most`` evenly spaced ranks."""
    v = sorted(values)
    mids = [(a + b) / 2 for a, b in zip(v, v[1:]) if a < b]
    if len(mids) <= most:
        return mids
    return sorted({mids[k * (len(mids) - 1) // (most - 1)] for k in range(most)})


def best_condition(rows: list[tuple[dict, bool]]) -> Condition | None:
    """The threshold test with the highest information gain for the rows to reject (true)."""
    p0 = sum(y for _, y in rows)
    n0 = len(rows) - p0
    if not p0 or not n0:
        return None
    before, best, found = math.log2(p0 / (p0 + n0)), 1e-9, None
    for f in FEATURES:
        pairs = sorted((r[f], y) for r, y in rows)
        cuts, k, p, n = cut_points([x for x, _ in pairs]), 0, 0, 0
        for t in cuts:
            while k < len(pairs) and pairs[k][0] < t:
                p, n, k = p + pairs[k][1], n + (not pairs[k][1]), k + 1
            for at_least, a, b in ((True, p0 - p, n0 - n), (False, p, n)):
                gain = a * (math.log2(a / (a + b)) - before) if a else 0
                if gain > best:
                    best, found = gain, Condition(f, at_least, t)
    return found


def learn_rules(rows: list[tuple[dict, bool]]) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune its tail on the rest, take the covered rows away.

    ``rows`` are (statistics, reject?) in any order; every third one prunes.
    """
    grow = [r for k, r in enumerate(rows) if k % 3]
    prune = [r for k, r in enumerate(rows) if k % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        conditions: list[Condition] = []
        left = grow
        while len(conditions) < MAX_CONDITIONS and (c := best_condition(left)):
            conditions.append(c)
            left = [r for r in left if c.holds(r[0])]
        best, kept = -1.0, None
        for k in range(1, len(conditions) + 1):
            rule = Rule(tuple(conditions[:k]))
            hit = [y for r, y in prune if rule.holds(r)]
            worth = sum(hit) / len(hit) if len(hit) >= MIN_COVER else -1.0
            if worth > best:
                best, kept = worth, rule
        if kept is None or best < MIN_PRECISION:
            return rules
        rules.append(kept)
        grow = [r for r in grow if not kept.holds(r[0])]
        prune = [r for r in prune if not kept.holds(r[0])]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), 0 if none does: an ordered conditional expression."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), F.lit(k))
    return out.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn a list from documents with a 0/1 ``quality`` label, on at most ``sample_rows`` of them."""
    chosen = (
        labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_id"), "quality")
        .orderBy(F.xxhash64("_id"), "_id", "quality").limit(sample_rows)
    )
    known = docs.select("doc_id", text).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # bounded by sample_rows
    found = with_statistics(known, text).where("not base_failed").select("_id", "quality", *FEATURES).collect()
    rows = sorted(((r["_id"], *[float(r[f]) for f in FEATURES], int(r["quality"])) for r in found), key=lambda r: ((r[0] * 2654435761) % 4294967296, r))
    return learn_rules([(dict(zip(FEATURES, r[1:-1])), r[-1] == 0) for r in rows])


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with statistics, base_failed, rule (the first that rejects, 0 if none) and kept.

    A null or empty text has no words, so it fails the base. Every row is judged by itself: repeated rows are equal,
    an empty table stays empty, columns of the added names are replaced.
    """
    out = with_statistics(docs.drop("rule", "kept"), text).withColumn("rule", verdict(rules).cast("int"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents, under a list learned from the quality labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *BASE, "base_failed", "rule", "kept")
