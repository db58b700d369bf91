"""Exact duplicates by skew-safe combining: local, then salted, then global winners, with the full content compared at every stage.

Texts are equal if they are identical without white space. Every task first combines its own rows of one digest and content (the partial
aggregation; the salt is the task's number, so a task has one salt). Winners of one salt are merged, then the salts' winners of a digest meet.
The content is a key of all three stages, so rows of one digest and different contents are never merged. A group with a third of all rows
leaves one row a task in the first stage, and one row a salt in the second.

The result goes back to the rows by the digest. Groups of more than max(HOT, rows / MOST_HOT) rows are less than MOST_HOT in number, by
counting, and are broadcast; their rows then spread over all partitions. All other groups are shuffled. Where a digest stands for
several contents, its rows are joined by digest and content instead.

Defined cases: a null text counts as empty, and empty and blank texts are equal; of equal texts the row with the most code points stays,
then the one with the smallest id, and a null id comes after all others; of rows that repeat both, one stays; very long texts are compared
whole; an empty table gives no rows; other columns are kept as they are where asked for, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_IDS, SPACE_CLASS, materialize

#: Salts of a digest: at most so many rows of a content meet in the last stage, and a salt gets one row from each of (tasks / SALTS).
SALTS = 64
#: Groups of more rows than this can be broadcast, if they also hold more than one row in MOST_HOT.
HOT, MOST_HOT = 1000, 100_000


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def _facts(docs: DataFrame, id_col: str, text_col: str, digest, keep: list[str]) -> DataFrame:
    """id, chars (code points), n (text without white space), sha256, g (digest that deals the rows) and the kept columns (row)."""
    text = F.coalesce(_column(text_col).cast("string"), F.lit(""))
    row = F.struct(*[_column(c) for c in keep]) if keep else F.lit(None).cast("int")
    base = docs.select(row.alias("row"), _column(id_col).alias("id"), F.length(text).cast("long").alias("chars"), F.regexp_replace(text, f"{SPACE_CLASS}+", "").alias("n"))
    base = base.select("*", F.sha2("n", 256).alias("sha256"))
    return base.select("*", (digest(F.col("n")) if digest else F.col("sha256")).alias("g"))


def winners(facts: DataFrame, salts: int = SALTS) -> DataFrame:
    """g, n, best (minus code points, id is null, id) and size of every group of equal texts, dealt by g."""
    own = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), "id")
    rows = facts.select("g", "n", own.alias("best"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("g", "salt", "n").agg(F.min("best").alias("best"), F.count("*").alias("size"))
    return salted.repartition("g").groupBy("g", "n").agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def _spread(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """facts with best and size of their groups (g, best, size; one row a digest): large groups are broadcast and their rows spread."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    least = max(HOT, total // MOST_HOT)
    hot = groups.where(F.col("size") > least).select("g", F.col("best").alias("hot_best"), F.col("size").alias("hot_size"))
    cold = groups.where(F.col("size").between(2, least)).select("g", F.lit(-1).cast("long").alias("place"), "best", "size")
    rows = facts.join(F.broadcast(hot), "g", "left")
    rows = rows.withColumn("place", F.when(F.col("hot_size").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))))
    rows = rows.join(cold, ["g", "place"], "left")
    return rows.withColumn("best", F.coalesce("hot_best", "best")).withColumn("size", F.coalesce("hot_size", "size"))


def _marked(docs: DataFrame, id_col: str, text_col: str, salts: int, digest, keep: list[str]) -> tuple[DataFrame, int]:
    """Every row with id, chars, sha256, row, keep_id, size and best (is it as good as its group's winner); and the number of groups."""
    found = winners(_facts(docs, id_col, text_col, digest, []), salts)
    # The winners lie dealt by g, so the contents of a digest are counted without another shuffle.
    groups = materialize(found.groupBy("g").agg(F.count("*").alias("contents"), F.min("best").alias("best"), F.max("size").alias("size")), "exact-groups")
    n = groups.agg(F.sum("contents")).first()[0] or 0
    facts = _facts(docs, id_col, text_col, digest, keep)
    mixed = groups.where("contents > 1").select("g")
    if mixed.isEmpty():
        rows = _spread(facts.drop("n"), groups)
    else:
        mixed = F.broadcast(mixed) if mixed.count() <= MOST_IDS else mixed
        apart = materialize(found.join(mixed, "g", "left_semi"), "exact-apart")
        rows = _spread(facts.join(mixed, "g", "left_anti").drop("n"), groups.where("contents = 1"))
        rows = rows.select("id", "chars", "sha256", "row", "best", "size").unionByName(facts.join(mixed, "g", "left_semi").join(apart, ["g", "n"]).select("id", "chars", "sha256", "row", "best", "size"))
    wins = F.col("best").isNull() | ((F.col("best.less") == -F.col("chars")) & F.col("best.id").eqNullSafe(F.col("id")))
    keep_id = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return rows.select("id", "chars", "sha256", "row", keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), wins.alias("best")), n


def _settled(rows: DataFrame, n: int, tag: str) -> DataFrame:
    """rows, written, with `kept`: of the best rows of a group (there are several if a row is repeated) the first; n: number of groups."""
    rows = materialize(rows.withColumn("token", F.monotonically_increasing_id()), tag)
    best = rows.where("best")
    if best.count() == n:
        return rows.withColumn("kept", F.col("best"))
    first = best.groupBy("sha256").agg(F.min("token").alias("token")).select("token", F.lit(True).alias("first"))
    first = materialize(first, f"{tag}-firsts")
    return rows.join(first, "token", "left").withColumn("kept", F.coalesce("first", F.lit(False)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=None) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row. digest: from the normalised text; SHA-256 if none is given."""
    rows, n = _marked(docs, id_col, text_col, salts, digest, [])
    out = _settled(rows, n, "exact-rows")
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), "kept", F.col("sha256").alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows, n = _marked(docs, id_col, text_col, salts, digest, docs.columns)
    return _settled(rows.where("best"), n, "exact-kept").where("kept").select("row.*")


ORACLE = """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS n FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY n) AS group_size FROM t WINDOW w AS (PARTITION BY n ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r"""
