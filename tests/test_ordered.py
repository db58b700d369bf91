"""Ordered operators against plain Python models, at their limits."""

import random
import time
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from skywright.operators import frames, ordered, vision


def model_dedup(hashes, window=20, bits=5):
    kept, out = deque(maxlen=window), []
    for h in hashes:
        dup = any(((h ^ k) & (2**64 - 1)).bit_count() <= bits for k in kept)
        out.append(dup)
        if not dup:
            kept.append(h)
    return out


def dedup(spark, streams, **how):
    rows = [(s, i, h) for s, hs in streams.items() for i, h in enumerate(hs)]
    random.Random(3).shuffle(rows)
    got = ordered.dedup_window(spark.createDataFrame(rows, "s string, i int, hash bigint"), ["s"], ["i"], **how).collect()
    return {s: [r["is_duplicate"] for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["i"])] for s in streams}


def test_dedup_limits(spark):
    far = [((1 << 63) - 1) ^ sum(1 << (k % 63) for k in range(3 * j, 3 * j + 12)) for j in range(25)]
    streams = {"edge": [0, 0b11111, 0b111111], "rejected": [0, 0b11111, 0b1111111111], "negative": [-1, -2, 5], "evicted": [0, *[(i * 0x9E3779B97F4A7C15) % 2**63 for i in range(1, 22)], 0], "far": far, "empty": []}
    got = dedup(spark, streams)
    for s, hs in streams.items():
        assert got[s] == model_dedup(hs), s
    assert got["edge"] == [False, True, False]
    assert got["evicted"][-1] is False


def test_dedup_long_random_streams(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(40)]
    streams = {s: [rng.choice(base) ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for _ in range(3000)] for s in "abc"}
    got = dedup(spark, streams)
    for s in streams:
        assert got[s] == model_dedup(streams[s])
    assert 0 < sum(got["a"]) < 3000


def test_sampler_accepts_equal_gap(spark):
    rows = [("a", i, t) for i, t in enumerate([0.0, 1.9, 2.0, 3.9, 4.0, 4.0, 9.0])]
    df = spark.createDataFrame(rows, "s string, i int, t double")
    got = [r["accepted"] for r in ordered.sample_interval(df, ["s"], ["i"], "t").orderBy("i").collect()]
    assert got == [True, False, True, False, True, False, True]


def test_motion_limits(spark):
    rows = [("a", 0, [0] * 4), ("a", 1, [25, 26, 0, 0]), ("a", 2, [51, 52, 26, 0]), ("b", 0, [9] * 4)]
    df = spark.createDataFrame(rows, "s string, i int, p array<int>")
    got = [(r["motion_score"], r["has_motion"]) for r in ordered.with_motion(df, ["s"], ["i"], "p", least=2).orderBy("s", "i").collect()]
    assert got == [(100, True), (1, False), (3, True), (100, True)]


@pytest.mark.parametrize("n", [0, 3, 4, 5, 8])
def test_batches(spark, n):
    df = spark.range(n).select(F.lit("s").alias("s"), "id")
    full = ordered.batches(df, ["s"], ["id"], {"ids": "id"}).orderBy("batch_id").collect()
    assert [r["ids"] for r in full] == [list(range(k, k + 4)) for k in range(0, n - n % 4, 4)]
    every = ordered.batches(df, ["s"], ["id"], {"ids": "id"}, keep_partial=True)
    assert sum(r["n"] for r in every.collect()) == n


@settings(max_examples=6, deadline=None)
@given(st.sets(st.text(alphabet="abcxyz0123", min_size=1, max_size=6), max_size=60))
def test_split_is_exact_and_disjoint(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = ordered.exact_split(df, "name").collect()
    n = len(names)
    count = {s: sum(r["split"] == s for r in rows) for s in ("train", "val", "test")}
    assert count == {"train": int(n * 0.7), "val": int(n * 0.2), "test": n - int(n * 0.7) - int(n * 0.2)}
    assert {r["name"] for r in rows} == names and len(rows) == n


def test_strict_mode_never_emits_a_batch(spark, sf_dir):
    from skywright.plans.catalogue import QUERIES

    strict = {r["vec_id"]: r for r in QUERIES["pipeline_strict"](spark, sf_dir).collect()}
    intended = {r["vec_id"]: r for r in QUERIES["pipeline_intended"](spark, sf_dir).collect()}
    assert {r["status"] for r in strict.values()} == {"skipped"}
    assert {r["status"] for r in intended.values()} >= {"skipped", "waiting_for_batch"}
    for k, r in intended.items():
        same = r["reason"] in ("duplicate", "invalid_image", "no_motion")
        assert strict[k]["reason"] == (r["reason"] if same else "duplicate")


def test_unknown_mode_is_an_error(spark):
    with pytest.raises(ValueError):
        frames.run_pipeline(spark.range(1), ["id"], ["id"], "id", mode="other")


@pytest.mark.parametrize("pieces", [1, 2, 7, 64])
def test_numbers_in_pieces(spark, pieces):
    rng = random.Random(pieces)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, k int, i int")
    got = {(r["s"], r["i"]): r["rn"] for r in ordered.numbered(df, ["s"], ["k", "i"], pieces=pieces).collect()}
    want = {}
    for s in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {(s, r[2]): n for n, r in enumerate(mine, 1)}
    assert got == want
    assert ordered.numbered(df.limit(0), ["s"], ["k", "i"], pieces=pieces).count() == 0
    names = spark.createDataFrame([(f"pre_{i}.jpg",) for i in range(300)], "name string")
    assert [r["name"] for r in ordered.numbered(names, [], ["name"], "n", pieces).orderBy("n").collect()] == sorted(f"pre_{i}.jpg" for i in range(300))


def model_suppress(boxes, threshold):
    kept, out = [], []
    for c, b in boxes:
        def over(a):
            w, h = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0), max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
            union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
            return w * h / union if union > 0 else 0.0

        out.append(not any(k == c and over(a) > threshold for k, a in kept))
        if out[-1]:
            kept.append((c, b))
    return out


def test_suppression_is_greedy(spark):
    from skywright.operators import vision

    rng, rows = random.Random(4), []
    for image in range(30):
        for i in range(rng.randrange(40)):
            x, y = rng.randrange(20), rng.randrange(20)
            rows.append((image, i, rng.randrange(2), [float(x), float(y), x + float(rng.randrange(12)), y + 9.0]))
    df = spark.createDataFrame(rows, "image int, i int, class_id int, bbox array<double>")
    got = {(r["image"], r["i"]): r["kept"] for r in vision.suppress(df, "image", ["i"], 0.4).collect()}
    for image in range(30):
        mine = [r for r in rows if r[0] == image]
        assert [got[image, r[1]] for r in mine] == model_suppress([(r[2], r[3]) for r in mine], 0.4)
    assert len(got) == len(rows) and 0 < sum(got.values()) < len(got)


def test_pipeline_on_bytes_equals_a_model(spark):
    rng, rows = random.Random(9), []
    for i in range(120):
        rows.append(("s", i, rng.choice([0, 0b11111111, 1 << 40]) + (i << 20), bytearray(rng.choice([0, 200]) for _ in range(16)), rng.random() > 0.2, rng.random() * 20))
    df = spark.createDataFrame(rows, "s string, i int, h bigint, p binary, ok boolean, v double")
    got = {r["i"]: r for r in frames.run_pipeline(df, ["s"], ["i"], "i", hash_col="h", valid=F.col("ok"), pixels="p", variance=F.col("v"), window=3, bits=2, least_motion=7, sharpness=5, batch=4).collect()}
    kept, previous, n = deque(maxlen=3), None, 0
    for _, i, h, p, ok, v in rows:
        score = None if previous is None else sum(abs(a - b) > 25 for a, b in zip(previous, p, strict=True))
        if any((h ^ k).bit_count() <= 2 for k in kept):
            want = ("skipped", "duplicate", None, None)
        else:
            kept.append(h)
            if not ok:
                want = ("skipped", "invalid_image", None, None)
            else:
                previous = p
                if score is not None and score <= 7:
                    want = ("skipped", "no_motion", score, None)
                elif v < 5:
                    want = ("skipped", "blurry", None, None)
                else:
                    n += 1
                    want = ("waiting_for_batch" if n % 4 else "batch_ready", None, None, (n - 1) // 4)
        assert (got[i]["status"], got[i]["reason"], got[i]["motion_score"], got[i]["batch_id"]) == want, i
    assert n > 8


def test_folds_in_pieces(spark):
    """Streams in pieces give the rows of one fold, whether the guesses at the borders are right or never are."""
    rng = random.Random(17)
    rows, t = [], 0.0
    for i in range(900):
        t += rng.choice([0.0, 0.3, 0.9, 4.0])
        rows.append((rng.choice("aab"), i, rng.choice([3, 2**40, rng.getrandbits(63)]) ^ (1 << rng.randrange(60)), t))
    rows += [("c", 0, 5, 0.0), (None, 1, 5, 0.0), (None, 2, 5, 1.0)]
    df = spark.createDataFrame(rows, "s string, i int, hash bigint, t double")
    got = lambda d, c: sorted((r["s"] or "", r["i"], r[c]) for r in d.collect())
    whole = got(ordered.dedup_window(df, ["s"], ["i"]), "is_duplicate")
    for size in (1, 40, 5000):
        if size > 1:
            assert got(ordered.dedup_window(df, ["s"], ["i"], piece_rows=size), "is_duplicate") == whole
        assert got(ordered.sample_interval(df.where("i < 60"), ["s"], ["i"], "t", 7.0, piece_rows=max(size, 7)), "accepted") == got(ordered.sample_interval(df.where("i < 60"), ["s"], ["i"], "t", 7.0), "accepted")
    count = lambda state, v: (state + 1, state + 1)
    few = df.where("i < 50 and s = 'a'")
    counted, rounds = ordered.fold_in_pieces(few.withColumn("v", F.col("i")), ["s"], ["i"], int, count, ["v"], "n", T.LongType(), 6, 2)
    assert [n for *_, n in got(counted, "n")] == list(range(1, few.count() + 1)) and rounds == -(-few.count() // 6)  # one piece a round
    right, rounds = ordered.fold_in_pieces(df.withColumn("v", F.col("i")), ["s"], ["i"], lambda: None, lambda state, v: (v, state), ["v"], "before", T.LongType(), 100, 2)
    assert rounds == 1 and got(right, "before") == got(df.withColumn("before", F.lag("i").over(Window.partitionBy("s").orderBy("i"))), "before")
    assert ordered.dedup_window(df.limit(0), ["s"], ["i"], piece_rows=10).count() == 0


def test_many_wrong_pieces_take_few_rounds(spark):
    """A state that never forgets: all pieces are wrong, or the wrong place wanders from piece to piece; rounds do not grow with the pieces."""
    df = spark.createDataFrame([(s, i, i) for s in ("a", None) for i in range(240)], "s string, i int, v int")
    counted, rounds = ordered.fold_in_pieces(df, ["s"], ["i"], int, lambda state, v: (state + 1, state + 1), ["v"], "n", T.LongType(), 6, 2)
    assert sorted((r["s"] or "", r["i"], r["n"]) for r in counted.collect()) == sorted((s, i, i + 1) for s in ("", "a") for i in range(240)) and rounds <= 3
    dense = df.withColumn("t", (F.col("i") * F.lit(1000.0) + F.col("i") % 7) / 50)  # pieces shorter than the interval, grids that never meet
    got = lambda d: sorted(map(repr, d.select("s", "i", "accepted").collect()))
    assert got(ordered.sample_interval(dense, ["s"], ["i"], "t", 333.0, piece_rows=5)) == got(ordered.sample_interval(dense, ["s"], ["i"], "t", 333.0))


def test_pieces_without_rows_of_their_own(spark):
    """Streams that end with a full piece: the rows before the next one, which does not exist, leave the other pieces' ends alone."""
    rng, rows = random.Random(29), []
    for s in "abcdefgh":
        t = 0.0
        for i in range(60):
            t += rng.choice([0.0, 0.4, 1.1, 6.0])
            rows.append((s, i, t))
    df = spark.createDataFrame(rows, "s string, i int, t double")
    got = lambda d: sorted(map(repr, d.select("s", "i", "accepted").collect()))
    for size in (5, 10, 12):
        assert got(ordered.sample_interval(df, ["s"], ["i"], "t", 7.0, piece_rows=size)) == got(ordered.sample_interval(df, ["s"], ["i"], "t", 7.0))


def test_running_sums_in_ranges(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice("ab"), i, rng.randrange(9)) for i in range(300)] + [(None, 7, 1), ("a", None, 2)], "s string, i int, v int")
    got = lambda p: sorted(map(repr, ordered.running(df, ["s"], ["i"], {"sum": F.col("v"), "n": F.lit(1)}, p).collect()))
    assert got(1) == got(7) == got(40)


def test_suppression_in_crowded_images(spark):
    """Some thousand boxes in one image, and small images, against the plain rule."""
    rng = random.Random(23)
    rows = []
    for image, n in [(1, 2500), (2, 30), (3, 5), (None, 3), (5, 1)]:
        for k in range(n):
            x, y = rng.uniform(0, 200), rng.uniform(0, 200)
            rows.append((image, k, rng.choice([0, 1]), [x, y, x + rng.uniform(5, 30), y + rng.uniform(5, 30)] if k % 97 != 5 else None))
    rows.append((3, 9, None, [0.0, 0.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "image int, rank int, class_id int, bbox array<double>")
    got = {(r["image"], r["rank"]): r["kept"] for r in vision.suppress(df, "image", ["rank"], 0.3).collect()}
    assert len(got) == len(rows)
    kept = {}
    for image, rank, c, box in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        clear = all(k != c or vision._overlap(b, box) <= 0.3 for k, b in kept.get(image, []))
        assert got[image, rank] == clear, (image, rank)
        if clear:
            kept.setdefault(image, []).append((c, box))
    assert 0 < sum(got.values()) < len(rows)
    many = [(7, k, 0, [rng.uniform(0, 3000), 0.0, 0.0, 0.0]) for k in range(10_000)]
    many = [(i, k, c, [b[0], b[0] % 977, b[0] + 40, b[0] % 977 + 40]) for i, k, c, b in many]
    began = time.time()
    vision._kept([0] * len(many), [b for *_, b in many], 0.7)
    assert time.time() - began < 10
    assert vision.suppress(df.limit(0), "image", ["rank"]).count() == 0
