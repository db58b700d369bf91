"""Live streams: replayed file sources, rate limits, and the stateful frame stages as arbitrary state of Structured Streaming.

Each processor keeps its state by stream key, so micro-batch borders never reset it: a window of accepted hashes, the previous frame, the
last accepted time, or the members of an unfinished batch, in RocksDB. Within a micro-batch the rows of a key go in their order. State of
streams that are idle for long can be dropped. The batch twins of these operators are in skywright.operators.ordered.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skywright.functions import exprs, images
from skywright.operators import ordered
from skywright.sources.storage import run_dir
from skywright.streaming.replay import END, replay_rows

#: Seconds between messages of each source.
PAUSE = {"drone": 0.5, "satellite": 5.0, "gis": 2.0, "social": 1.0}


def replay(spark: SparkSession, schema: T.StructType | str, path: str, kind: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """A bounded source of files as a stream, a number of files a trigger."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def message_stream(paths: DataFrame, kind: str) -> DataFrame:
    """A stream of rows with `path` (social: id, text, hazard) as messages of a kind, sent now."""
    now = F.unix_micros(F.current_timestamp()) / 1e6
    if kind == "social":
        return paths.select(*exprs.social_message(F.col("id"), F.col("text"), F.col("hazard"), now))
    return paths.select(*{"drone": exprs.drone_message, "gis": exprs.gis_message, "satellite": exprs.satellite_message}[kind](F.col("path"), now))


def paced_messages(spark: SparkSession, path: str, kind: str, rows: int = 1, clock: str = "wall", progress: str | None = None) -> DataFrame:
    """The messages of a kind from a folder of Parquet files (columns as in message_stream), one after each of the source's pauses."""
    schema = "id string, text string, hazard string" if kind == "social" else "path string"
    return message_stream(replay_rows(spark, schema, path, PAUSE[kind], rows, clock, progress), kind)


@contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, on the executors' disks and not in their heaps; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_to_end(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Runs a bounded stream to its end, into Parquet in the shared folder, and returns what it wrote.

    With the same base again it goes on where it was stopped. A replay (see skywright.streaming.replay) admits its rows step by step, so
    all that is available is waited for. Not for streams whose state goes by processing time (idle_ms): these never come to rest.
    """
    spark = stream.sparkSession
    base = base or f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state")
    with state_store(spark):
        query = writer.start(f"{base}/out")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _rows(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of a key in a micro-batch, in order; the source bounds how many it admits."""
    return pd.concat(list(parts)).sort_values(order, kind="stable")


class _Dedup(StatefulProcessor):
    """State: the list of the last accepted hashes, `window` at most."""

    def __init__(self, key: str, order: str, hash_col: str, window: int, bits: int, idle_ms: int | None):
        self.key, self.order, self.hash_col, self.window, self.bits, self.idle_ms = key, order, hash_col, window, bits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "hash bigint", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        kept, found, marks = [int(r[0]) for r in self.kept.get()], _rows(rows, [self.order]), []
        for h in map(int, found[self.hash_col]):
            near = ordered.is_near(kept, h, self.bits)
            marks.append(near)
            if not near:
                kept = ordered.remembered(kept, h, self.window)
        self.kept.put([(h,) for h in kept])
        yield pd.DataFrame({self.key: found[self.key], self.order: found[self.order], "is_duplicate": marks})


class _Motion(StatefulProcessor):
    """State: the pixels of the previous frame."""

    def __init__(self, key: str, order: str, pixels: str, delta: int, least: int, first: int, idle_ms: int | None):
        self.key, self.order, self.pixels, self.delta, self.least, self.first, self.idle_ms = key, order, pixels, delta, least, first, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.previous = handle.getValueState("previous", "pixels binary", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np

        before, found = self.previous.get()[0] if self.previous.exists() else None, _rows(rows, [self.order])
        scores, moves = [], []
        for data in found[self.pixels]:
            score = self.first if before is None else images.motion_score(np.frombuffer(before, np.uint8), np.frombuffer(data, np.uint8), self.delta)
            scores.append(int(score))
            moves.append(bool(before is None or score > self.least))
            before = bytes(data)
        self.previous.update((before,))
        yield pd.DataFrame({self.key: found[self.key], self.order: found[self.order], "motion_score": scores, "has_motion": moves})


class _Sample(StatefulProcessor):
    """State: the time of the last accepted row."""

    def __init__(self, key: str, order: list[str], seconds: str, interval: float, idle_ms: int | None):
        self.key, self.order, self.seconds, self.interval, self.idle_ms = key, order, seconds, interval, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seconds double", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        last, found, marks = self.last.get()[0] if self.last.exists() else None, _rows(rows, self.order), []
        for t in map(float, found[self.seconds]):
            marks.append(last is None or t - last >= self.interval)
            last = t if marks[-1] else last
        if last is not None:
            self.last.update((last,))
        yield found[[self.key, *self.order]].assign(accepted=marks)


class _Batches(StatefulProcessor):
    """State: number of batches so far, when the stream ends (its last event time plus a gap), its timer, and the members of the unfinished batch.

    All of it is one value, and a timer that is set stays: when it comes before the stream's end it is set anew. Each call of the state store is a
    message, and with many short streams these are most of the work.
    """

    def __init__(self, key: str, order: list[str], members: dict[str, str], schema: T.StructType, size: int, time: str | None, gap_ms: int, idle_ms: int | None):
        self.key, self.order, self.members, self.schema, self.size, self.time, self.gap_ms, self.idle_ms = key, order, members, schema, size, time, gap_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField(n, T.LongType()) for n in ("done", "ends", "timer")]
        self.state = handle.getValueState("state", T.StructType([*fields, T.StructField("pending", T.ArrayType(self.schema))]), self.idle_ms)

    def _frame(self, key, batches: list[tuple[int, list[tuple]]]) -> pd.DataFrame:
        out = {self.key: [key[0]] * len(batches), "batch_id": [k for k, _ in batches]}
        return pd.DataFrame(out | {name: [[m[i] for m in rows] for _, rows in batches] for i, name in enumerate(self.members)})

    def handleInputRows(self, key, rows, timerValues):
        found = _rows(rows, self.order)
        done, ends, timer, pending = self.state.get() or (0, None, None, [])
        pending = [*map(tuple, pending), *zip(*(found[c].tolist() for c in self.members.values()), strict=True)]
        full = len(pending) // self.size
        ready = [(done + k, pending[k * self.size : (k + 1) * self.size]) for k in range(full)]
        if self.time is not None:
            ends = int(found[self.time].max().timestamp() * 1000) + self.gap_ms
            if timer is not None and ends < timer:
                self.handle.deleteTimer(timer)
                timer = None
            if timer is None:
                self.handle.registerTimer(timer := ends)
        self.state.update((done + full, ends, timer, pending[full * self.size :]))
        if ready:
            yield self._frame(key, ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done, ends, _, rest = self.state.get()
        if ends > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ends)
            self.state.update((done, ends, ends, rest))
            return
        self.state.update((done + bool(rest), ends, None, []))
        if rest:
            yield self._frame(key, [(done, list(map(tuple, rest)))])


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, out: T.StructType, idle_ms: int | None) -> DataFrame:
    """State by key, which goes after idle_ms without a row of the key, if that is set."""
    return df.groupBy(key).transformWithStateInPandas(processor, out, "append", "processingTime" if idle_ms else "none")


def dedup(df: DataFrame, key: str, order: str, hash_col: str = "hash", window: int = ordered.DEDUP_WINDOW, bits: int = ordered.DEDUP_BITS, idle_ms: int | None = None) -> DataFrame:
    """key, order, is_duplicate."""
    out = T.StructType([df.schema[key], df.schema[order], T.StructField("is_duplicate", T.BooleanType())])
    return _stateful(df.select(key, order, hash_col), key, _Dedup(key, order, hash_col, window, bits, idle_ms), out, idle_ms)


def motion(df: DataFrame, key: str, order: str, pixels: str = "gray320", delta: int = ordered.MOTION_DELTA, least: int = ordered.MOTION_PIXELS, first: int = ordered.FIRST_SCORE, idle_ms: int | None = None) -> DataFrame:
    """key, order, motion_score, has_motion; pixels: equally long byte strings."""
    out = T.StructType([df.schema[key], df.schema[order], T.StructField("motion_score", T.LongType()), T.StructField("has_motion", T.BooleanType())])
    return _stateful(df.select(key, order, pixels), key, _Motion(key, order, pixels, delta, least, first, idle_ms), out, idle_ms)


def sample(df: DataFrame, key: str, order: str | list[str], seconds: str, interval: float = ordered.SAMPLE_SECONDS, idle_ms: int | None = None) -> DataFrame:
    """key, order (one column or more), accepted."""
    order = [order] if isinstance(order, str) else order
    out = T.StructType([df.schema[key], *[df.schema[c] for c in order], T.StructField("accepted", T.BooleanType())])
    return _stateful(df.select(*dict.fromkeys([key, *order, seconds])), key, _Sample(key, order, seconds, interval, idle_ms), out, idle_ms)


def batches(df: DataFrame, key: str, order: str | list[str], members: str | dict[str, str], size: int = ordered.BATCH, time: str | None = None, gap: str = "0 seconds", late: str = "0 seconds", idle_ms: int | None = None) -> DataFrame:
    """key, batch_id and the members (output name -> column; one column: `members`) of each full batch.

    With an event-time column `time`, a stream ends when the watermark (`late` behind the latest time of all streams) passes the stream's
    last time by `gap`, and its unfinished batch comes out then. So it hangs on the rows' times alone, and not on when they are processed; the
    end mark of a replay passes all times, and no stream keeps a rest.
    """
    order, members = [order] if isinstance(order, str) else order, {"members": members} if isinstance(members, str) else members
    kinds = [df.schema[c].dataType for c in members.values()]
    out = T.StructType([df.schema[key], T.StructField("batch_id", T.LongType()), *[T.StructField(n, T.ArrayType(k)) for n, k in zip(members, kinds, strict=True)]])
    state = T.StructType([T.StructField(n, k) for n, k in zip(members, kinds, strict=True)])
    columns = list(dict.fromkeys([key, *order, *members.values(), *([time] if time else [])]))
    step = _Batches(key, order, members, state, size, time, int(pd.Timedelta(gap).total_seconds() * 1000), idle_ms)
    if time is None:
        return _stateful(df.select(*columns), key, step, out, idle_ms)
    rows = df.select(*columns).withWatermark(time, late).where(F.col(time) < F.lit(END))  # a replay's end mark moves the watermark and goes
    return rows.groupBy(key).transformWithStateInPandas(step, out, "append", "eventTime")


# Extensions: the reference has no event time. These are Spark's own windows on the messages' timestamps.


def tumbling_counts(df: DataFrame, time: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    w = df.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), by, "n")


def session_counts(df: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    w = df.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def distinct_messages(df: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
