"""Connected components of a link table by contraction; no link or label leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (ids). Returns node and label, the smallest id of its component, for every node with a link.

    In a round every node hooks to its least neighbour below it (partial minima before the shuffle, so a node with very many links is no
    bottleneck), pointers are followed to their roots by doubling, and the links between different roots are the next round's. These get
    fewer by half at least, so only the first round reads all links. Rounds end when no link is left.
    """
    both = links.where(F.col("a") != F.col("b")).select("a", "b").unionByName(links.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "cc-links")
    labels = None
    for _ in range(most_rounds):
        roots = _roots(both, most_rounds)
        of = lambda x: roots.select(F.col("node").alias(x), F.col("label").alias(f"root_{x}"))  # noqa: B023, E731
        rest = both.join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b")
        before, both = both, materialize(rest.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "cc-links")
        release(before)
        if labels is None:
            labels = roots.select("node", "label")
        else:
            root = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = materialize(labels.join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "cc-labels")
            release(roots)
        if both.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _roots(both: DataFrame, most_rounds: int) -> DataFrame:
    """node and the root of its pointers (label)."""
    up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-roots")
    for _ in range(most_rounds):
        far = up.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = materialize(up.join(far, "label").select("node", F.col("label").alias("old"), F.col("far").alias("label")), "cc-roots")
        release(up)
        up = after
        if up.where(F.col("old") != F.col("label")).isEmpty():
            return up
    raise RuntimeError(f"pointers did not settle in {most_rounds} rounds")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (node, label) with further links (a, b), which are mapped to labels first."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    links = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    links = materialize(links.select("a", "b", F.coalesce("label_a", "a").alias("la"), F.coalesce("label_b", "b").alias("lb")), "cc-more")
    found = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    root = found.select(F.col("node").alias("label"), F.col("label").alias("root"))
    new = links.select(F.col("a").alias("node"), F.col("la").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("lb").alias("label")))
    every = labels.unionByName(new).distinct()
    return every.join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
