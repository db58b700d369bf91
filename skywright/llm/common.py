"""Shared pieces of the training-data operators: table access, durable intermediate tables, text constants."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywright.sources.storage import file_system, run_dir

#: The character classes of the two word definitions used by these operators.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SEPARATOR_CLASS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once, whatever the text lengths are.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings of the Arrow stages; executors get this library's place on their path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_skywright_path"] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing lazy reads any more, so that a long job's intermediate tables do not add up."""
    for df in tables:
        fs, path = file_system(df.sparkSession, df.__dict__["_skywright_path"])
        fs.delete(path, True)


def sample_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The `rows` distinct rows of df whose key hashes lowest (all, if there are no more); ties go by all columns.

    Rows are counted first, and a threshold on the hash lets through about 1.2 times as many as asked for (and 1,000 more). What
    passes is made distinct with partial aggregation, so neither a large table nor a key with very many rows reaches one task whole.
    """
    share = min(1.0, (1.2 * rows + 1000) / max(df.count(), 1))
    while True:
        low = df if share >= 1 else df.where(F.xxhash64(key) < F.lit(int(share * 2.0**64) - 2**63))
        low = materialize(low.distinct(), "sample")
        if share >= 1 or low.count() >= rows:
            return low.orderBy(F.xxhash64(key), *[F.col(f"`{c}`") for c in df.columns]).limit(rows)
        share = min(1.0, 2 * share)


def fresh(name: str, *taken) -> str:
    """A column name like `name` that is in none of the lists `taken`; Spark does not tell names apart by case."""
    used = {c.lower() for names in taken for c in names}
    found = f"__{name}"
    while found.lower() in used:
        found += "_"
    return found


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row: a lambda variable holds it, so nested lambdas do not compute it again."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """value, marked so that the optimizer neither copies it into later filters and projections nor moves a filter on it below it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def give_back() -> None:
    """Returns what a Python worker no longer uses to the system; workers outlive their tasks, and stages that need none leave them idle."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def chunks(texts: list, most_chars: int = 1 << 20):
    """(start, end) ranges of texts with about most_chars characters each; one longer text makes a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most_chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


#: Ids that are sent to all executors at most; they are counted first, and more of them go through a shuffle.
MOST_IDS = 200_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is in ids (one column); rows with a null id stay."""
    gone = fresh("gone", docs.columns)
    ids = materialize(ids.toDF(gone).where(F.col(gone).isNotNull()).distinct(), "gone")
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids[gone], "left_anti")
