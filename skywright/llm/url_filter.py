"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits.

Features are DataFrame expressions over the URL alone: length, depth, digit ratio, character entropy, parameter counts and a
smoothed statistic of the host's suffix. They are trained from labelled URLs: a table of the caller's, or else the URLs that the rules
settle, labelled by their verdicts. Boosting runs on the driver over a bounded sample (`sample_rows`, a documented parameter); the trees become
nested conditional expressions, so judging is a narrow native stage without shuffle.

Defined cases: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by the trees on its length
features; very long URLs are read whole; ties between splits go to the first feature, a score at the threshold is allowed; labels of one kind
only give a constant score; without labels every score is 0.5 and allowed; URLs that repeat with the same label count once; repeated URLs are
judged alike; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, once, sample_by_hash

#: Fixed values: (verdict, rule); a rule is a host and the start of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

FEATURES = ["url_chars", "host_chars", "host_labels", "path_chars", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "n_params", "n_hyphens", "n_escapes", "longest_label", "suffix_rate"]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    cut = lambda c, stops: F.regexp_extract(c, f"^[^{stops}]*", 0)
    host = cut(rest, "/?#")
    return ascii_lower(host), cut(F.substr(rest, F.length(host) + 1), "?#")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def _entropy(text: Column) -> Column:
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / F.greatest(n, F.lit(1))
    bits = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(F.greatest(share(c), F.lit(1e-9)))))
    return F.aggregate(bits, F.lit(0.0), lambda a, x: a + x)


def suffix_of(host: Column) -> Column:
    """The last two labels of a host: what stands for its registrar or hosting service."""
    return F.regexp_extract(host, "[^.]*\\.?[^.]*$", 0)


def features(url: Column, host: Column, path: Column, rates: dict[str, float], prior: float) -> Column:
    """A struct of FEATURES; rates: the smoothed share of blocked URLs by suffix, of a bounded sample."""
    without = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    u = F.coalesce(url, F.lit(""))
    rate = F.lit(prior)
    if rates:
        rate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(rates.items()) for x in kv]), suffix_of(host)), rate)
    return F.struct(
        F.length(u).alias("url_chars"), F.length(host).alias("host_chars"), (without(host, ".") + 1).alias("host_labels"),
        F.length(path).alias("path_chars"), without(path, "/").alias("depth"),
        F.round(per(without(u, "0123456789"), F.length(u)), 6).alias("digit_ratio"), F.round(per(without(host, "0123456789"), F.length(host)), 6).alias("host_digit_ratio"),
        F.round(_entropy(u), 6).alias("entropy"), F.round(_entropy(host), 6).alias("host_entropy"),
        (F.when(F.instr(u, "?") > 0, 1).otherwise(0) + without(u, "&")).alias("n_params"), without(host, "-").alias("n_hyphens"), without(u, "%").alias("n_escapes"),
        F.array_max(F.transform(F.split(host, "\\."), lambda x: F.length(x))).alias("longest_label"), F.round(rate, 6).alias("suffix_rate"),
    )


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.left.predict(x), self.right.predict(x))

    def column(self, f: Column) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(f[FEATURES[self.feature]] <= self.threshold, self.left.column(f)).otherwise(self.right.column(f))


@dataclass
class Boosted:
    """score = 1 / (1 + exp(-(base + sum of trees))): how likely a URL is to be blocked."""

    base: float
    trees: list[Node]
    rates: dict[str, float]
    prior: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x))))))

    def score(self, f: Column) -> Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + t.column(f)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int) -> Node:
    """A regression tree on gradients g and curvatures h (Newton leaves, second-order gain)."""
    node = Node(round(float(rate * g.sum() / (h.sum() + 1.0)), 9))
    if depth == 0 or len(x) < 2 * least:
        return node
    best = (1e-9, -1, 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, gs, hs = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(x) - cut - 1 >= least)]
        if len(cut):
            gain = gs[cut] ** 2 / (hs[cut] + 1.0) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1.0) - whole
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), k, round(float(v[cut[i]] + v[cut[i] + 1]) / 2, 9))
    if best[1] < 0:
        return node
    m = x[:, best[1]] <= best[2]
    if m.all() or not m.any():
        return node
    node.feature, node.threshold = best[1], best[2]
    node.left, node.right = _grow(x[m], g[m], h[m], depth - 1, rate, least), _grow(x[~m], g[~m], h[~m], depth - 1, rate, least)
    return node


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 20, depth: int = 3, rate: float = 0.3, least: int = 10) -> tuple[float, list[Node]]:
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    base = round(float(np.log(p / (1 - p))), 9)
    f, trees = np.full(len(y), base), []
    if len(y) == 0 or y.all() or not y.any():
        return base, trees
    for _ in range(n_trees):
        q = 1 / (1 + np.exp(-f))
        tree = _grow(x, y - q, q * (1 - q), depth, rate, least)
        if tree.left is None:
            break
        trees.append(tree)
        f = f + tree.predict(x)
    return base, trees


def learn(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", sample_rows: int = 20_000, least_suffix: int = 20, **how) -> Boosted:
    """labelled: URLs with a boolean label. At most sample_rows different ones, those whose URL hashes lowest, go to the driver."""
    rows = labelled.select(F.col(url_col).cast("string").alias("u"), F.col(label_col).cast("boolean").alias("b")).where(F.col("u").isNotNull() & F.col("b").isNotNull())
    rows = sample_by_hash(rows, "u", sample_rows)
    host, path = host_path(F.col("u"))
    rows = rows.select("u", "b", host.alias("host"), path.alias("path"))
    got = rows.select("b", suffix_of(F.col("host")).alias("s"), features(F.col("u"), F.col("host"), F.col("path"), {}, 0.0).alias("f")).select("b", "s", "f.*").collect()
    y = np.array([r[0] for r in got], float)
    prior = round(float((y.sum() + 1) / (len(y) + 2)), 6)
    by: dict[str, list[float]] = {}
    for r in got:
        by.setdefault(r[1], []).append(float(r[0]))
    rates = {s: round((sum(v) + 5 * prior) / (len(v) + 5), 6) for s, v in by.items() if len(v) >= least_suffix}  # sample_rows / least_suffix at most
    x = np.array([r[2:] for r in got], float).reshape(-1, len(FEATURES))
    if len(got):
        x[:, -1] = [rates.get(r[1], prior) for r in got]
    base, trees = boost(x, y, **how)
    return Boosted(base, trees, rates, prior)


def rule_labels(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """url and blocked of the URLs that a rule settles."""
    url = F.col(url_col).cast("string")
    verdict = rule_of(F.col("host"), F.col("path"), rules)[1] if rules else F.lit(None).cast("string")
    found = pages.select(url.alias("url"), *[c.alias(n) for c, n in zip(host_path(url), ("host", "path"), strict=True)]).select("url", verdict.alias("verdict"))
    return found.where(F.col("verdict").isNotNull()).select("url", (F.col("verdict") == "block").alias("blocked"))


def judge(pages: DataFrame, model: Boosted | None = None, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, labelled: DataFrame | None = None, **how) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score (of the trees). Without a model, one is trained from `labelled` (url, blocked) or rule_labels()."""
    if model is None:
        model = learn(rule_labels(pages, rules, url_col) if labelled is None else labelled, **how)
    url = F.col(url_col).cast("string")
    host, path = host_path(url)
    base = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules) if rules else (F.lit(None).cast("string"),) * 2
    f = features(F.col("url"), F.col("host"), F.col("path"), model.rates, model.prior)
    scored = base.select("id", "host", "path", rule.alias("rule"), verdict.alias("settled"), once(let(f, model.score)).alias("score"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("settled", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")
