"""Quality rules: statistics of texts as column expressions, and a decision list learned on them.

The list is learned by sequential covering: a rule grows by the threshold that gains most, is
pruned on rows that it was not grown on, and the rows it covers leave the table before the next
rule. It is emitted as one ordered CASE expression, so that scoring stays inside Spark's codegen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landmesh.llm.common import table

#: At most so many labelled rows are read to learn from, those of the smallest hash.
SAMPLE_ROWS = 20_000
#: A pruned rule must reject so many bad rows and so pure on the pruning rows.
MIN_COVER, MIN_PRECISION = 3, 0.97
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 48

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\f\r"

#: Learned statistics: ratios of the base counts and of letter kinds, in [0, 1] but for the means.
FEATURES = ["words_log", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio", "digit_ratio", "distinct_ratio"]


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base counts of a text; null counts as empty, which has no words.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as longs, and the letter counts
    n_upper, n_marks, n_digits, n_distinct for FEATURES. Columns of those names are replaced.
    """
    t = F.col("__t")
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__w", F.filter(F.split(F.translate(t, SPACE, " " * 6), " "), lambda w: w != ""))
    n = F.size("__w")
    # Windows of three words by hash and place; after sorting, equal windows are neighbours.
    windows = F.when(n >= 3, F.sort_array(F.transform(F.slice("__w", 1, n - 2), lambda w, i: F.struct(F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i")))))
    df = df.withColumn("__g", F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>")))
    df = df.withColumn("__p", F.sort_array(_repeated("__g")))
    # A repeated window covers three words, or fewer where the next repeated one begins.
    covered = F.aggregate(
        F.transform("__p", lambda p, k: F.least(F.coalesce(F.get("__p", k + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    out = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, SPACE, "")),
        "n_symbols": _removed(t, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")),
        "n_marks": _removed(t, "!?"),
        "n_digits": _removed(t, "0123456789"),
        "n_distinct": F.size(F.array_distinct("__w")),
    }
    return df.withColumns({k: v.cast("long") for k, v in out.items()}).drop("__t", "__w", "__g", "__p")


def _repeated(grams: str) -> Column:
    """Places of the windows that have an equal neighbour in the sorted array."""
    h = lambda k: F.get(F.col(grams), k)["h"]
    kept = F.filter(
        F.transform(grams, lambda x, k: F.when(x["h"].eqNullSafe(h(k - 1)) | x["h"].eqNullSafe(h(k + 1)), x["i"])),
        lambda i: i.isNotNull(),
    )
    return kept


def features() -> dict[str, Column]:
    """FEATURES from the counts; every one is 0 for a text without words."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "words_log": F.log1p("n_words"),
        "word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_words"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "upper_ratio": ratio("n_upper", "word_chars"),
        "mark_ratio": ratio("n_marks", "word_chars"),
        "digit_ratio": ratio("n_digits", "word_chars"),
        "distinct_ratio": ratio("n_distinct", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Rule:
    """A conjunction of thresholds: (feature, whether at or above, value)."""

    conditions: list[tuple[int, bool, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, above, cut in self.conditions:
            out &= (x[:, f] >= cut) if above else (x[:, f] < cut)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, cut in self.conditions:
            out &= (F.col(FEATURES[f]) >= cut) if above else (F.col(FEATURES[f]) < cut)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'>=' if above else '<'} {cut:.6g}" for f, above, cut in self.conditions)


def _best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, tuple[int, bool, float]] | None:
    """The threshold of most information gain (FOIL's) among cuts beside quantiles of the bad rows."""
    p, n = int(bad.sum()), int((~bad).sum())
    before, best = math.log2(p / (p + n)), None
    for f in range(x.shape[1]):
        values = x[:, f]
        distinct = np.unique(values)
        at_bad = np.unique(np.searchsorted(distinct, np.quantile(values[bad], np.linspace(0, 1, CUTS), method="nearest")))
        # Cuts stand midway between neighbouring values.
        between = np.unique(np.concatenate([at_bad, at_bad + 1]))
        between = between[(between > 0) & (between < len(distinct))]
        for cut in (distinct[between - 1] + distinct[between]) / 2:
            at = values >= cut
            for above in (True, False):
                inside = at if above else ~at
                p1, n1 = int((inside & bad).sum()), int((inside & ~bad).sum())
                if p1 and p1 + n1 < p + n:
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - before)
                    if best is None or gain > best[0]:
                        best = gain, (f, above, float(cut))
    return best


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Ordered rules that reject; rows that no rule covers are kept.

    x: rows of FEATURES, bad: labels. Every third row is for pruning. Without bad rows, or without
    any rule that is pure enough, the list is empty.
    """
    rules: list[Rule] = []
    prune = np.arange(len(x)) % 3 == 2
    while len(rules) < MAX_RULES:
        grow_x, grow_bad = x[~prune], bad[~prune]
        if not grow_bad.any():
            break
        rule, inside = Rule(), np.ones(len(grow_x), dtype=bool)
        while len(rule.conditions) < MAX_CONDITIONS and (grow_bad[inside].any() and not grow_bad[inside].all()):
            found = _best_condition(grow_x[inside], grow_bad[inside])
            if found is None or found[0] <= 0:
                break
            rule.conditions.append(found[1])
            inside = rule.covers(grow_x)
        if not rule.conditions:
            break
        worth = []
        for k in range(1, len(rule.conditions) + 1):
            hit = Rule(rule.conditions[:k]).covers(x[prune])
            p, n = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
            worth.append(((p - n) / max(1, p + n), p, n, k))
        score, p, n, k = max(worth, key=lambda w: (w[0], w[1]))
        rule = Rule(rule.conditions[:k])
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        left = ~rule.covers(x)
        x, bad, prune = x[left], bad[left], prune[left]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a row, null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.column(), F.lit(i)).otherwise(out)
    return out


def learn_from(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most `rows` labelled documents, those whose ids have the smallest hash.

    Rows without label or document are left out; statistics are computed for the sample only. An id
    that is labelled twice, or that several documents have, counts as often. Without any labelled
    document there are no rules.
    """
    sample = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    counted = with_counts(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    got = counted.select((F.col("quality") == 0).alias("bad"), "doc_id", *(c.alias(k) for k, c in features().items())).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x = np.array([r[2:] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    return learn(x, np.array([r.bad for r in got], dtype=bool))


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """documents with counts, features, base_failed, rule (null if none fired) and kept.

    Every row stays, also of null or repeated id; null text has no words and fails the base rules.
    Columns of the added names are replaced. An empty table gives no rows.
    """
    out = with_counts(documents).withColumns(features()).withColumn("base_failed", base_failed())
    out = out.withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that are kept, with their own columns, whatever they are called; each row is
    judged by itself, so that rows of null or repeated id stay or go by their texts.

    The row number keeps the filter above the counts (Spark pushes none below a column that isn't
    deterministic): pushed below, it would hold the counts' expressions many times over.
    """
    rows = documents.select("text", F.struct(*documents.columns).alias("__row"))
    judged = judge(rows, rules).withColumn("__at", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("__at") >= 0)).select("__row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_from(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
