"""Quality rules: learned decision lists over text statistics, as ordered Spark conditional expressions.

`statistics` are DataFrame expressions over the whole text. `learn` takes the statistics of a bounded sample of labelled rows
(`sample_rows`, a documented parameter) to the driver and runs sequential covering there: a rule is grown one threshold condition
at a time by information gain on two thirds of the rows, pruned from its end on the remaining third, kept if it is precise enough
there, and the rows it covers leave. `verdict` turns the list into one CASE expression, so judging all rows is a narrow, native
stage without shuffle.

Defined cases: a null or blank text has no words, so all its statistics are 0 and it fails the base rules; labels other than 0 and
1, null or absent, are not learned from; without labels of both kinds the learned list is empty and only the base rules judge;
a tie between two conditions goes to the one listed first; rows that repeat id and text count once in learning and are judged alike; an empty
table gives no rows; other columns are ignored, or kept as they are, whatever their names (see judge()). Very long texts are read whole; windows
of eight words are compared by a 64-bit hash within one text (under 1e-10 of texts of 40,000 words could be counted wrongly).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, UPPER, fresh, let, once, sample_by_hash

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8

#: What rules may ask of a text; all are ratios or plain sizes, so a threshold means the same at every length.
FEATURES = ["symbols_per_char", "repeat_share", "dup_line_share", "distinct_share", "upper_share", "digit_share", "mark_share", "chars_per_word", "words_per_line"]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; hashes in window order."""

    def of_sorted(s: Column) -> Column:
        same = lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"])
        return let(F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])), of_starts)

    def of_starts(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    return let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)


def repeat_words(words: Column) -> Column:
    """Words in windows of eight words that are found twice or more in the text, the first included."""
    each = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    some = lambda w: F.when(F.array_size(F.array_distinct(w)) == F.array_size(w), F.lit(0)).otherwise(_covered(w))
    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(let(F.transform(w, lambda x: F.xxhash64(x)), each), some)))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, as_: str = "__stats") -> DataFrame:
    """The kept columns (all by default) and one column `as_`, a struct of counts and of the features."""
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # One character stands for its class, so one pass over the text tells all classes apart.
    classes = {" ": SPACES, "#": SYMBOLS, "A": UPPER, "0": "0123456789", ".": "!?.,;:"}
    marked = F.translate(text, "".join(classes.values()), "".join(mark * len(chars) for mark, chars in classes.items()))
    count_of = lambda m, mark: F.length(m) - F.length(F.replace(m, F.lit(mark), F.lit("")))
    counts = let(words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), repeat_words(w).alias("n_repeat_words")))
    raw = let(counts, lambda c: let(dup_lines(text), lambda d: let(marked, lambda m: F.struct(
        c["n_words"].cast("long").alias("n_words"),
        F.length(F.replace(m, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        count_of(m, "#").cast("long").alias("n_symbols"),
        d["dup"].cast("long").alias("n_dup_lines"),
        c["n_repeat_words"].cast("long").alias("n_repeat_words"),
        d["n"].alias("n_lines"), c["n_distinct"].alias("n_distinct"),
        count_of(m, "A").alias("n_upper"), count_of(m, "0").alias("n_digits"), count_of(m, ".").alias("n_marks"),
    ))))

    def features(c: Column) -> Column:
        part = lambda a, b: F.round(c[a] / F.greatest(c[b].cast("double"), F.lit(1.0)), 6)
        return F.struct(
            *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            part("n_symbols", "word_chars").alias("symbols_per_char"), part("n_repeat_words", "n_words").alias("repeat_share"),
            part("n_dup_lines", "n_lines").alias("dup_line_share"), part("n_distinct", "n_words").alias("distinct_share"),
            part("n_upper", "word_chars").alias("upper_share"), part("n_digits", "word_chars").alias("digit_share"),
            part("n_marks", "word_chars").alias("mark_share"), part("word_chars", "n_words").alias("chars_per_word"),
            part("n_words", "n_lines").alias("words_per_line"),
        )

    return docs.select(*[F.col(f"`{c}`") for c in keep], once(let(raw, features)).alias(as_))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, stats: Column) -> Column:
        return stats[self.feature] > self.threshold if self.above else stats[self.feature] <= self.threshold


@dataclass(frozen=True)
class Rule:
    """All conditions hold -> the text is bad. precision and covered: on the rows left for pruning."""

    conditions: tuple[Condition, ...]
    precision: float = 0.0
    covered: int = 0

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self, stats: Column) -> Column:
        """Number of the first rule that holds, from 1; 0 where none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            cond = rule.conditions[0].column(stats)
            for c in rule.conditions[1:]:
                cond = cond & c.column(stats)
            out = F.when(cond, k) if out is None else out.when(cond, k)
        return F.lit(0) if out is None else out.otherwise(0)


def _candidates(x: np.ndarray, bins: int) -> list[Condition]:
    out = []
    for k, name in enumerate(FEATURES):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1), method="lower"))
        out += [Condition(name, above, float(t)) for t in cuts for above in (True, False)]
    return out


def _centred(c: Condition, x: np.ndarray) -> Condition:
    """The same split of these rows with its threshold in the middle of the gap between both sides."""
    v, m = x[:, FEATURES.index(c.feature)], c.holds(x)
    if m.all() or not m.any():
        return c
    low, high = (v[~m].max(), v[m].min()) if c.above else (v[m].max(), v[~m].min())
    return Condition(c.feature, c.above, round((float(low) + float(high)) / 2, 9))


def cover(x: np.ndarray, bad: np.ndarray, min_precision: float = 0.95, min_covered: int = 3, most_rules: int = 12, most_conditions: int = 3, bins: int = 40) -> DecisionList:
    """Sequential covering. x: rows by FEATURES; bad: booleans; the order of rows decides which third prunes."""
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    out = DecisionList()
    while len(out.rules) < most_rules and (left & bad & ~prune).any():
        grow_x, grow_y = x[left & ~prune], bad[left & ~prune]
        tries = _candidates(grow_x[grow_y], bins) + _candidates(grow_x, bins)
        masks = [c.holds(grow_x) for c in tries]
        now, conditions = np.ones(len(grow_x), bool), []
        while len(conditions) < most_conditions and not grow_y[now].all():
            p0, n0 = (now & grow_y).sum(), now.sum()
            hits = np.array([(m & now & grow_y).sum() for m in masks], float)
            alls = np.array([(m & now).sum() for m in masks], float)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(hits > 0, hits * (np.log2(hits / alls) - np.log2(p0 / n0)), -1.0)
            best = int(np.argmax(gain))
            if gain[best] <= 1e-9:
                break
            conditions.append(_centred(tries[best], grow_x[now]))
            now &= conditions[-1].holds(grow_x)
        if not conditions:
            break
        px, py = x[left & prune], bad[left & prune]
        worth = []
        for k in range(1, len(conditions) + 1):
            m = Rule(tuple(conditions[:k])).holds(px)
            p, n = int((m & py).sum()), int((m & ~py).sum())
            worth.append(((p - n) / max(p + n, 1), -k))
        k = -max(worth)[1]
        rule = Rule(tuple(conditions[:k]))
        m = rule.holds(x) & left
        p, n = int((m & bad & prune).sum()), int((m & prune).sum())
        if n < min_covered or p < min_precision * n or (m & bad).sum() < min_precision * m.sum():
            break
        out.rules.append(Rule(rule.conditions, p / n, n))
        left &= ~m
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, **how) -> DecisionList:
    """Learns from at most sample_rows labelled rows, those whose ids hash lowest; their ids are broadcast, so the bound holds there too."""
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1))
    sample = sample_by_hash(usable, "__id", sample_rows)
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    stats = statistics(chosen, "__text", ["__id", "__label"])
    s = F.col("__stats")
    rows = stats.select(F.xxhash64("__id").alias("order"), "__label", base_failed(s).alias("failed"), *[s[f].alias(f) for f in FEATURES]).distinct().collect()
    rows = sorted(r for r in rows if not r[2])
    x = np.array([r[3:] for r in rows], float).reshape(-1, len(FEATURES))
    bad = np.array([r[1] == 0 for r in rows], bool)
    return cover(x, bad, **how)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, with n_words ... n_repeat_words, base_failed, rule (0: none) and kept. These win over kept columns of the same names."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*counts, "base_failed", "rule", "kept")]
    stats = fresh("stats", docs.columns)
    s = F.col(stats)
    return statistics(docs, text_col, keep, stats).select(
        *[F.col(f"`{c}`") for c in keep], *[s[c].alias(c) for c in counts], base_failed(s).alias("base_failed"), rules.verdict(s).alias("rule"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows that neither the base rules nor the learned ones reject, with their columns as they are."""
    stats = fresh("stats", docs.columns)
    s = F.col(stats)
    return statistics(docs, text_col, None, stats).where(~base_failed(s) & (rules.verdict(s) == 0)).drop(stats)
