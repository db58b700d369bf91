"""Writers: topics, label files, split folders, console."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from skywright.functions import exprs
from skywright.sources.schemas import TOPICS
from skywright.sources.storage import file_system


def to_topic(messages: DataFrame, kind: str) -> DataFrame:
    """topic and JSON value of messages, as the Kafka sink takes them."""
    return messages.select(F.lit(TOPICS[kind]).alias("topic"), exprs.wire(*messages.columns).alias("value"))


def write_kafka(envelopes: DataFrame, servers: str = "localhost:9092", checkpoint: str | None = None) -> StreamingQuery | None:
    """Sends topic/value rows; needs Spark's Kafka connector on the class path."""
    if envelopes.isStreaming:
        return envelopes.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()
    return envelopes.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def write_topics(envelopes: DataFrame, folder: str) -> None:
    """The same rows as JSON text under topic=... folders, for places without a broker."""
    envelopes.write.mode("overwrite").partitionBy("topic").text(folder)


#: Partitions of a topic in a log.
LOG_PARTITIONS = 8


def append_log(envelopes: DataFrame, epoch: int, folder: str, partitions: int = LOG_PARTITIONS, order: str = "value") -> bool:
    """Appends topic/value rows to a log as one epoch, once: an epoch that is there already is left as it is (False).

    A message lies in the partition of its value's hash, with an offset that follows the partition's last one, in order of `order` within the
    epoch. Rows and next offsets are written to a folder of the attempt, and one rename makes both visible; so a retried or restarted epoch leaves
    no message twice, and a broken attempt is never read. The file system's rename must be atomic (HDFS, local disks).
    """
    spark = envelopes.sparkSession
    fs, at = file_system(spark, f"{folder}/epochs/epoch={epoch:012d}")
    if fs.exists(at):
        return False
    attempt = f"{folder}/attempts/{epoch:012d}-{uuid.uuid4().hex}"
    keyed = envelopes.select("topic", F.pmod(F.xxhash64("value"), F.lit(partitions)).cast("int").alias("partition"), "value", *({order} - {"topic", "value"}))
    past = _next_offsets(spark, folder)
    number = F.row_number().over(Window.partitionBy("topic", "partition").orderBy(order))
    rows = keyed.withColumn("place", number).join(F.broadcast(past), ["topic", "partition"], "left")  # a row for each partition of each topic
    rows.select("topic", "partition", (F.coalesce("next", F.lit(0)) + F.col("place") - 1).alias("offset"), "value").write.parquet(f"{attempt}/rows")
    count = spark.read.parquet(f"{attempt}/rows").groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next"))
    past.unionByName(count).groupBy("topic", "partition").agg(F.max("next").alias("next")).coalesce(1).write.parquet(f"{attempt}/next")
    fs.mkdirs(at.getParent())
    done = fs.rename(file_system(spark, attempt)[1], at)
    if not done and not fs.exists(at):
        raise OSError(f"epoch {epoch} could not be put in place")
    return done


def _epochs(spark: SparkSession, folder: str) -> list[str]:
    fs, at = file_system(spark, f"{folder}/epochs/epoch=*")
    return sorted(str(x.getPath().toString()) for x in fs.globStatus(at) or [])


def _next_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """topic, partition and the next offset, as the last epoch left them."""
    last = _epochs(spark, folder)[-1:]
    return spark.read.parquet(f"{last[0]}/next") if last else spark.createDataFrame([], "topic string, partition int, next bigint")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """topic, partition, offset, value and epoch of every message of a log's finished epochs."""
    found = _epochs(spark, folder)
    if not found:
        return spark.createDataFrame([], "topic string, partition int, offset bigint, value string, epoch bigint")
    rows = spark.read.schema("topic string, partition int, offset bigint, value string").parquet(*[f"{x}/rows" for x in found])
    return rows.withColumn("epoch", F.regexp_extract(F.col("_metadata.file_path"), "epoch=([0-9]+)", 1).cast("bigint"))


def write_log(envelopes: DataFrame, folder: str, checkpoint: str, partitions: int = LOG_PARTITIONS) -> DataStreamWriter:
    """A writer that appends every micro-batch of topic/value rows to a log; the stream's batch number is the epoch."""
    return envelopes.writeStream.foreachBatch(lambda df, epoch: append_log(df, epoch, folder, partitions) and None).option("checkpointLocation", checkpoint)


def write_files(files: DataFrame, folder: str) -> None:
    """One file for each row (name, data: binary) below a folder, written by the executors; existing files are replaced."""

    def put(rows) -> None:
        where, base = place_of(folder)
        for r in rows:
            path = f"{base}/{r['name']}"
            where.create_dir(path.rpartition("/")[0], recursive=True)
            with where.open_output_stream(path) as f:
                f.write(bytes(r["data"]))

    files.select("name", "data").foreachPartition(put)


def write_label_files(files: DataFrame, folder: str) -> None:
    """One `stem.txt` for each row (stem, text)."""
    write_files(files.select(F.concat("stem", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("data")), folder)


def place_of(path: str):
    """The file system of a path on an executor (local, HDFS, object stores), and the path there."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path if re.match("[a-z0-9]+:/", path) else f"file://{path}")


def write_splits(rows: DataFrame, folder: str) -> None:
    """The table under split=... folders; what was there before goes."""
    rows.write.mode("overwrite").partitionBy("split").parquet(folder)


def copy_splits(rows: DataFrame, folder: str) -> DataFrame:
    """Copies each row's image, and its label file where it has one, to <folder>/<split>/images|labels. Returns what was copied.

    A missing image is an error, a missing label file is not. Two images of one split with the same base name would overwrite each
    other and are an error too.
    """
    name = exprs.base_name(F.col("image_path"))
    twice = rows.groupBy("split", name.alias("name")).count().where("count > 1").select("name").head(1)
    if twice:
        raise ValueError(f"two images of a split are called {twice[0]['name']}")

    def run(batches):
        import shutil

        import pyarrow as pa
        import pyarrow.fs as fs

        to, base = place_of(folder)
        for b in batches:
            done = []
            for path, label, split in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for source, part in ((path, "images"), (label, "labels")):
                    if source is None:
                        continue
                    place, at = place_of(source)
                    if part == "labels" and place.get_file_info(at).type == fs.FileType.NotFound:
                        continue
                    to.create_dir(f"{base}/{split}/{part}", recursive=True)
                    with place.open_input_stream(at) as a, to.open_output_stream(f"{base}/{split}/{part}/{at.rpartition('/')[2]}") as z:
                        shutil.copyfileobj(a, z, 1 << 20)
                    done.append((split, part, source))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(3)], ["split", "part", "source"])

    return rows.select("image_path", "label_path", "split").mapInArrow(run, "split string, part string, source string")


def console(df: DataFrame, rows: int = 20) -> StreamingQuery | None:
    if df.isStreaming:
        return df.writeStream.format("console").option("numRows", rows).start()
    return df.show(rows, truncate=False)
