"""Spelling variants by a symmetric-delete join: words one edit apart, the frequent form of each, and the root that forms lead to.

Every word emits itself and its distinct single deletions; words that share such a key are joined, and a pair is kept if the exact edit
distance is one. Two words at this distance share exactly one key (a replaced letter: the word without it; an inserted one: the
shorter word), so no pair is found twice. A key of m letters can be shared by (m + 1) * alphabet + 1 words at most. The pairs of a word are
aggregated: how many, and the one of largest count. Forms have at least `ratio` times their word's count, so chains of them end after
log(largest count) steps; pointer doubling follows them in the logarithm of that.

Words of more than LONG code points do not travel with all their keys: their keys are rolling hashes of all deletions (numpy, linear in
the word), pairs carry digests, and only the words of candidate pairs are fetched and compared.

Defined cases: a null text has no words; a null id changes nothing in a word's count; rows that repeat id and text count again; of forms
with equal counts the first in code-point order is taken; a word without one is its own root; very long texts are cut into words whole;
very long words are compared whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, prepare, release

LETTERS = 7
OCCURRENCES = 2
RATIO = 10
#: Code points up to which words are joined by their keys as text.
LONG = 64

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def without_letter(word: Column, at: Column) -> Column:
    """word without its code point `at` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, change=None) -> DataFrame:
    """word and n of all words of at least `letters` code points and `occurrences` places. change: (id, word) columns -> word, in every place.

    A change must not make words longer. Counts are combined in every task before the shuffle, so a very frequent word is no hot key.
    """
    run = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{letters},}}"), F.lit(0))
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(run).alias("word"))
    # lower() is quick, but changes letters beyond Z as well; the others are rare.
    found = found.select("id", F.when(F.col("word").rlike("[\\u00C0-\\u00DE]"), F.translate("word", UPPER, LOWER)).otherwise(F.lower("word")).alias("word"))
    if change is not None:
        found = found.select(change(F.col("id"), F.col("word")).alias("word")).where(F.length("word") >= letters)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _short_pairs(found: DataFrame) -> DataFrame:
    deleted = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: without_letter(F.col("word"), i))
    keys = F.array_distinct(F.concat(F.array("word"), deleted))
    rows = found.where(F.length("word") <= LONG).select(F.explode(keys).alias("key"), "word", "n")
    a, b = rows.alias("a"), rows.alias("b")
    near = (F.col("a.word") < F.col("b.word")) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    return a.join(b, (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))


def deletion_keys(word: str) -> np.ndarray:
    """Distinct hashes of a word and of all its single deletions, in time linear in its length."""
    c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    power = np.cumprod(np.append(np.uint64(1), np.full(n, _B)))
    inverse = np.cumprod(np.full(n, _B_INVERSE))
    before = np.append(np.uint64(0), np.cumsum(c * inverse)) * power  # hash of the first i letters
    rest = n - 1 - np.arange(n)
    after = before[n] - before[1:] * power[rest]
    deleted = before[:n] * power[rest] + after
    mixed = lambda h, length: (h ^ (h >> np.uint64(29))) * _B + np.uint64(length)
    return np.unique(np.append(mixed(deleted, n - 1), mixed(before[n:], n))).view(np.int64)


def _long_pairs(found: DataFrame) -> DataFrame:
    """The same for pairs with a word of more than LONG code points."""
    import pyarrow as pa

    prepare(found.sparkSession)

    def run(batches):
        for batch in batches:
            for digest, word in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys = deletion_keys(word)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([digest.as_py()] * len(keys), pa.binary()), pa.array(np.full(len(keys), len(word)))], ["key", "digest", "size"])

    long = materialize(found.where(F.length("word") >= LONG).select(F.unhex(F.sha2("word", 256)).alias("digest"), "word", "n"), "spelling-long")
    keys = long.select("digest", "word").mapInArrow(run, "key bigint, digest binary, size bigint")
    a, b = keys.alias("a"), keys.alias("b")
    fits = (F.col("a.digest") < F.col("b.digest")) & (F.abs(F.col("a.size") - F.col("b.size")) <= 1) & (F.greatest("a.size", "b.size") > LONG)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & fits).select(F.col("a.digest").alias("da"), F.col("b.digest").alias("db")).distinct()
    of = lambda x: long.select(F.col("digest").alias(f"d{x}"), F.col("word").alias(x), F.col("n").alias(f"n{x}"))
    both = pairs.join(of("a"), "da").join(of("b"), "db")
    return both.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def roots(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """word and root of every word with a form; links: word, form, without circles."""
    up = materialize(links.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(most_rounds):
        far = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = materialize(up.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        release(up)
        up = after
        if up.where("moved").isEmpty():
            return up.select("word", "root")
    raise RuntimeError(f"forms did not end in {most_rounds} rounds")


def variants(found: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of found (word, n; one row a word)."""
    found = materialize(found.select("word", "n"), "spelling-words")
    pairs = _short_pairs(found)
    if not found.where(F.length("word") > LONG).isEmpty():
        pairs = pairs.unionByName(_long_pairs(found))
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n"))))
    near = pairs.select(sides.alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = found.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "spelling-forms")
    root = roots(rows.where(F.col("form").isNotNull()).select("word", "form"))
    return rows.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
