"""Stateful stages over many micro-batches equal their batch twins."""

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywright.operators import ordered
from skywright.sources import sinks
from skywright.streaming import frames as live
from skywright.streaming import replay


def stream(spark, df, path, order, parts=5):
    """df as `parts` files, read one a trigger in order."""
    n = df.count()
    cut = spark.createDataFrame(df.orderBy(order).collect(), df.schema).coalesce(1)
    for k in range(parts):
        rows = cut.where((F.col(order) >= k * n // parts) & (F.col(order) < (k + 1) * n // parts))
        rows.coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return live.replay(spark, df.schema, f"{path}/*")


def test_dedup_sampler_batches_motion(spark, tmp_path):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(8)]
    rows = [(rng.choice("ab"), i, rng.choice(base) ^ (1 << rng.randrange(60)), i * 0.7, bytearray(rng.randrange(256) for _ in range(16))) for i in range(150)]
    df = spark.createDataFrame(rows, "s string, i int, hash bigint, t double, p binary")
    s = stream(spark, df, str(tmp_path / "in"), "i")
    key = lambda d, c: sorted((r["s"], r["i"], r[c]) for r in d.collect())
    assert key(live.run_to_end(live.dedup(s, "s", "i")), "is_duplicate") == key(ordered.dedup_window(df, ["s"], ["i"]), "is_duplicate")
    assert key(live.run_to_end(live.sample(s, "s", "i", "t")), "accepted") == key(ordered.sample_interval(df, ["s"], ["i"], "t"), "accepted")
    got = sorted((r["s"], r["batch_id"], r["members"]) for r in live.run_to_end(live.batches(s, "s", "i", "i")).collect())
    assert got == sorted((r["s"], r["batch_id"], r["m"]) for r in ordered.batches(df, ["s"], ["i"], {"m": "i"}).collect())
    wide = df.withColumn("q", F.transform(F.split(F.hex("p"), "(?<=\\G..)"), lambda x: F.when(x == "", 0).otherwise(F.conv(x, 16, 10)).cast("int")))
    batch = ordered.with_motion(wide.withColumn("q", F.slice("q", 1, 16)), ["s"], ["i"], "q", least=9)
    assert key(live.run_to_end(live.motion(s, "s", "i", "p", least=9)), "motion_score") == key(batch, "motion_score")


def test_event_time_extensions(spark, tmp_path):
    df = spark.createDataFrame([("a", i, i * 600) for i in range(60)], "s string, i int, sec int")
    s = stream(spark, df, str(tmp_path / "in"), "i", 3).select("s", "i", F.timestamp_seconds("sec").alias("ts"))
    day = live.tumbling_counts(s, "ts", "s", "1 hour", "0 seconds")
    assert sum(r["n"] for r in live.run_to_end(day).collect()) == 54  # the last hour stays open
    assert live.run_to_end(live.distinct_messages(s, "ts", ["s"], "1 day")).count() == 1
    assert live.session_counts(s, "ts", "s").isStreaming


def test_flush_by_event_time(spark, tmp_path):
    """A stream's rest comes out when the watermark passes its timer, and the end mark passes all of them; no clock is asked."""
    rows = [("a", i, 1000 + i) for i in range(6)] + [("b", 6, 1006)] + [("c", 7 + i, 5000 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "s string, i int, sec int").select("s", "i", F.timestamp_seconds("sec").alias("at"))
    replay.ordered_files(df.coalesce(1), ["i"], str(tmp_path / "in"))
    for end in (None, "at"):
        source = replay.replay_rows(spark, df.schema, str(tmp_path / "in"), pause=1, rows=7, clock="steps", end=end)
        got = live.run_to_end(live.batches(source, "s", "i", "i", time="at", gap="1 minute")).collect()
        want = [("a", 0, [0, 1, 2, 3]), ("a", 1, [4, 5]), ("b", 0, [6])] + ([("c", 0, [7, 8, 9])] if end else [])
        assert sorted((r["s"], r["batch_id"], r["members"]) for r in got) == want


def test_state_of_idle_streams_goes(spark, tmp_path):
    """Such a stream never comes to rest, so the test stops it when all rows are out."""
    df = spark.createDataFrame([("a", i, 7) for i in range(6)], "s string, i int, hash bigint")
    for ms, accepted in ((1, 2), (10**9, 1)):
        s, out = stream(spark, df, str(tmp_path / f"in{ms}"), "i", 2), str(tmp_path / f"out{ms}")
        with live.state_store(spark):
            query = live.dedup(s, "s", "i", idle_ms=ms).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").start(f"{out}/rows")
        try:
            end = time.time() + 40
            while sum(p["numInputRows"] for p in query.recentProgress) < 6 and time.time() < end:
                time.sleep(0.1)
        finally:
            query.stop()
        assert sum(not r["is_duplicate"] for r in spark.read.parquet(f"{out}/rows").collect()) == accepted


def test_restart_in_mid_stream(spark, tmp_path):
    """A stream that is stopped between micro-batches goes on at its row and with its state."""
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(8)]
    rows = [(rng.choice("ab"), i, rng.choice(base) ^ (1 << rng.randrange(60)), i * 0.7) for i in range(120)]
    df = spark.createDataFrame(rows, "s string, i int, hash bigint, t double")
    replay.ordered_files(df, ["i"], str(tmp_path / "in"))
    key = lambda d, c: sorted((r["s"], r["i"], r[c]) for r in d.collect())
    twins = {"is_duplicate": (lambda s: live.dedup(s, "s", "i"), ordered.dedup_window(df, ["s"], ["i"])), "accepted": (lambda s: live.sample(s, "s", "i", "t"), ordered.sample_interval(df, ["s"], ["i"], "t"))}
    for column, (stage, twin) in twins.items():
        here = str(tmp_path / column)
        source = lambda: replay.replay_rows(spark, df.schema, str(tmp_path / "in"), pause=1, rows=17, clock="steps", progress=f"{here}/progress")  # noqa: B023, E731
        with live.state_store(spark):
            query = stage(source()).writeStream.format("parquet").option("checkpointLocation", f"{here}/state").start(f"{here}/out")
        while not query.recentProgress:
            assert query.exception() is None
            time.sleep(0.05)
        query.stop()
        before = spark.read.parquet(f"{here}/out").count()
        assert key(live.run_to_end(stage(source()), base=here), column) == key(twin, column) and 0 < before


def test_offsets_of_a_replay(spark, tmp_path):
    df = spark.range(0, 100, numPartitions=4).select(F.col("id").cast("string").alias("path"), "id")
    replay.ordered_files(df, ["id"], str(tmp_path / "in"))
    options = {"path": str(tmp_path / "in"), "pause": "1", "rows": "30", "clock": "steps", "end": "at", "progress": str(tmp_path / "p")}
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("at", T.TimestampType())])
    plain = T.StructType([T.StructField("path", T.StringType())])
    read = lambda r, a, b: [x for p in r.partitions(a, b) for batch in r.read(p) for x in batch.to_pylist()]
    reader, at, got = replay._Reader(options | {"end": ""}, plain), {"file": 0, "row": 0}, []
    while (to := reader.latestOffset()) != at:
        got.append([int(x["path"]) for x in read(reader, at, to)])
        at = to
        if len(got) == 2:  # a restarted reader goes on behind the last planned batch
            reader = replay._Reader(options | {"end": ""}, plain)
    assert [len(x) for x in got] == [30, 30, 30, 10] and sum(got, []) == list(range(100))
    whole = replay._Reader({"path": options["path"], "end": "at"}, schema)
    end = whole.latestOffset()
    assert [p.path for p in whole.partitions(end, end)] == [] and whole.partitions({"file": 0, "row": 0}, end)[-1].path is None
    assert next(whole.read(replay._Slice(None, 0, 1))).to_pylist()[0]["path"] is None
    (tmp_path / "none").mkdir()
    assert replay._Reader({"path": str(tmp_path / "none")}, plain).latestOffset() == {"file": 0, "row": 0}


@pytest.mark.parametrize("kind, pause", [("drone", 0.5), ("satellite", 5.0), ("gis", 2.0), ("social", 1.0)])
def test_pace_of_each_source(spark, tmp_path, monkeypatch, kind, pause):
    """One message at once and one more after every pause, whenever the reader is asked; the clock is the test's."""
    assert live.PAUSE[kind] == pause
    rows = spark.range(0, 20, numPartitions=3).select(F.format_string("%03d", "id").alias("id"), F.lit("x").alias("text"), F.lit("fire").alias("hazard"), F.format_string("/d/%03d.jpg", "id").alias("path"))
    replay.ordered_files(rows, ["id"], str(tmp_path / "in"))
    now = [100.0]
    monkeypatch.setattr(replay.time, "monotonic", lambda: now[0])
    reader, at, out = replay._Reader({"path": str(tmp_path / "in"), "pause": str(pause)}, T.StructType([T.StructField("id", T.StringType())])), {"file": 0, "row": 0}, 0
    for passed in (0.0, 0.9, 1.0, 1.5, 3.0, 3.2, 7.0, 7.9, 30.0):  # in pauses
        now[0] = 100.0 + passed * pause
        to = reader.latestOffset()
        out += sum(p.last - p.first for p in reader.partitions(at, to))
        assert out == min(20, 1 + int(passed)), passed
        at = to
    live_rows = live.paced_messages(spark, str(tmp_path / "in"), kind, 6, "steps")
    seen: list[int] = []
    query = live_rows.writeStream.foreachBatch(lambda df, _: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [6, 6, 6, 2]


def test_a_log_has_each_message_once(spark, tmp_path):
    """Epochs that fail before and after their commit are run again at the restart."""
    df = spark.range(0, 60, numPartitions=1).select(F.format_string("%03d", "id").alias("path"))
    replay.ordered_files(df, ["path"], str(tmp_path / "in"))
    folder, state, fail = str(tmp_path / "log"), str(tmp_path / "state"), {1: "before", 2: "after"}

    def put(df, epoch):
        how = fail.pop(epoch, None)
        if how == "before":
            df.write.parquet(f"{folder}/attempts/{epoch:012d}-broken/rows")
            raise RuntimeError("lost before the commit")
        sinks.append_log(df, epoch, folder, 3)
        if how == "after":
            raise RuntimeError("lost after the commit")

    for _ in range(3):
        source = replay.replay_rows(spark, "path string", str(tmp_path / "in"), pause=1, rows=13, clock="steps", progress=str(tmp_path / "p"))
        rows = source.select(F.lit("drone-video").alias("topic"), F.col("path").alias("value"))
        query = rows.writeStream.foreachBatch(put).option("checkpointLocation", state).start()
        try:
            query.processAllAvailable()
        except Exception:
            pass
        finally:
            query.stop()
    got = sinks.read_log(spark, folder).collect()
    assert fail == {} and sorted(r["value"] for r in got) == [f"{i:03d}" for i in range(60)]
    for p in range(3):
        mine = sorted((r["offset"], r["epoch"]) for r in got if r["partition"] == p)
        assert [o for o, _ in mine] == list(range(len(mine))) and [e for _, e in mine] == sorted(e for _, e in mine)
    assert sinks.append_log(spark.createDataFrame([("t", "v")], "topic string, value string"), 0, folder, 3) is False
    assert sinks.read_log(spark, str(tmp_path / "no")).count() == 0


@pytest.mark.parametrize("name", ["stream_dedup", "stream_motion", "stream_sampler", "stream_batch4"])
def test_tables_whose_files_are_out_of_order(spark, sf_dir, same, tmp_path, name):
    """A table of many files, the last rows in the file that changed first, gives what the table of one file gives."""
    from skywright.plans import catalogue

    for table, order in (("embeddings", "vec_id"), ("events", "event_id")):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        n = rows.count()
        for k in range(3):
            part = rows.where((F.col(order) >= (2 - k) * n // 3) & (F.col(order) < (3 - k) * n // 3))
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"{table}.parquet"))
        assert spark.read.parquet(str(tmp_path / f"{table}.parquet")).count() == n
    same(catalogue.QUERIES[name](spark, str(tmp_path)), catalogue.ORACLES[name])
