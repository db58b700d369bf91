"""Operators over ordered streams: greedy folds, previous row, count batches, exact splits.

A stream is the rows of one partition key in an order that must be total. Window operators are plain SQL windows. Greedy folds, where a
row's outcome changes what later rows are compared with, run over partitions that are dealt by stream and sorted: state (at most a
window of hashes, or one time) passes from batch to batch, so a stream of any length takes constant memory. One stream is one
sequence and stays in one task; different streams run in parallel. Few and long streams are folded in pieces (`piece_rows`): every piece
starts from a guess, and only pieces whose guess was wrong are folded again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywright.sources.storage import written

#: Defaults of the frame stages.
DEDUP_WINDOW, DEDUP_BITS = 20, 5
SAMPLE_SECONDS = 2
MOTION_DELTA, MOTION_PIXELS, FIRST_SCORE = 25, 5000, 100
BATCH = 4
SPLIT_SEED, TRAIN, VAL = 42, 0.7, 0.2


def _values(column) -> Iterator:
    """Python values of an Arrow column; lists of numbers and byte strings as numpy arrays, without a copy where there are no nulls."""
    import numpy as np
    import pyarrow as pa

    if pa.types.is_list(column.type):
        if column.null_count:
            return (None if x is None else np.asarray(x) for x in column.to_pylist())
        flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
        return (flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
    if pa.types.is_binary(column.type):
        return (None if x is None else np.frombuffer(x, np.uint8) for x in column.to_pylist())
    return iter(column.to_pylist())


def ordered_fold(df: DataFrame, stream: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, object], tuple[object, object]], value: str | list[str], out: str, kind: T.DataType) -> DataFrame:
    """df with a column `out`: step(state, row's value) -> (state, result), from start() for every stream, in order.

    With a list of columns as `value`, step gets a tuple, and the columns that are only values (neither stream nor order) are left out.
    """
    import pyarrow as pa

    names = df.columns
    values = [value] if isinstance(value, str) else value
    kept = [c for c in names if isinstance(value, str) or c not in values or c in (*stream, *order)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, kind)])
    at, keys, stay = [names.index(c) for c in values], [names.index(c) for c in stream], [names.index(c) for c in kept]

    def run(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_type

        now: object = object()
        state: object = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            streams = list(zip(*columns, strict=True)) if keys else [()] * batch.num_rows
            got = []
            rows = batch.column(at[0]).to_pylist() if isinstance(value, str) else zip(*(_values(batch.column(k)) for k in at), strict=True)
            for s, v in zip(streams, rows, strict=True):
                if s != now:
                    now, state = s, start()
                state, r = step(state, v)
                got.append(r)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in stay), pa.array(got, to_arrow_type(kind))], [*kept, out])

    dealt = df.repartition(*[F.col(c) for c in stream]) if stream else df.coalesce(1)
    return dealt.sortWithinPartitions(*stream, *order).mapInArrow(run, schema)


def fold_in_pieces(df: DataFrame, stream: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, object], tuple[object, object]], value: list[str], out: str, kind: T.DataType, piece_rows: int, warm: int = 256, ranges: int = 32) -> tuple[DataFrame, int]:
    """ordered_fold() with long streams in pieces of `piece_rows` rows, each folded in a task of its own; and the number of rounds it took.

    A piece guesses the state at its first row by folding the `warm` rows before it from start(); greedy states forget, so the guess is
    mostly right. Then every piece's first state is compared with the last one of the piece before. Pieces where they differ are folded again from
    what came before, until none differs. Few of them are folded side by side in the first rounds. Many, or later ones, go in runs: wrong pieces that
    follow each other are folded one after the other in one task, with some pieces behind them, twice as many in each round. So rounds grow with the
    logarithm of the pieces, and a state that never forgets costs about one more fold of the whole stream. The result is that of one
    fold in any case. States travel as bytes; a state that counts rows is never guessed
    right (use running() for counts).
    """
    import pickle

    import pyarrow as pa

    from skywright.functions.log import log_info

    kept = [c for c in df.columns if c not in value or c in (*stream, *order)]
    names = [*stream, "__piece"]
    rows = numbered(df, stream, order, "__rn", ranges)
    here, place = F.floor((F.col("__rn") - 1) / piece_rows), F.pmod(F.col("__rn") - 1, F.lit(piece_rows))
    both = F.when(place >= piece_rows - warm, F.array(F.struct(here.alias("p"), F.lit(False).alias("w")), F.struct((here + 1).alias("p"), F.lit(True).alias("w")))).otherwise(F.array(F.struct(here.alias("p"), F.lit(False).alias("w"))))
    rows = rows.withColumn("__x", F.explode(both)).select(*df.columns, "__rn", F.col("__x.p").alias("__piece"), F.col("__x.w").alias("__warm"), F.lit(None).cast("binary").alias("__state"), F.col("__x.p").alias("__run"))
    rows = written(rows, "fold-rows")
    fields = [df.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField(out, kind), T.StructField("__piece", T.LongType()), T.StructField("__first", T.BinaryType()), T.StructField("__last", T.BinaryType())])
    columns = rows.columns
    runs = [*stream, "__run"]
    at, keys, stay = [columns.index(c) for c in value], [columns.index(c) for c in (*runs, "__piece")], [columns.index(c) for c in kept]
    warm_at, state_at = columns.index("__warm"), columns.index("__state")

    def run(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_type

        now, state, fresh, held = None, None, True, None

        def done(held: tuple):
            batch, which, got, first, last = held
            batch = batch.take(pa.array(which, pa.int64()))
            extra = [pa.array(got, to_arrow_type(kind)), batch.column(keys[-1]), pa.array(first, pa.binary()), pa.array(last, pa.binary())]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in stay), *extra], [*kept, out, "__piece", "__first", "__last"])

        for batch in batches:
            which, got, first, last = [], [], [], []
            pieces = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            values = zip(*(_values(batch.column(k)) for k in at), strict=True)
            for i, (p, v, warming, given) in enumerate(zip(pieces, values, batch.column(warm_at).to_pylist(), batch.column(state_at).to_pylist(), strict=True)):
                if p != now:
                    if not fresh:  # the piece had rows of its own, and not only some before it
                        (last if last else held[4])[-1] = pickle.dumps(state, 5)
                    if now is None or p[:-1] != now[:-1]:  # within a run the state goes on
                        state = start()
                    now, fresh = p, True
                if given is not None:  # the row that brings the state of the piece before
                    state = pickle.loads(given)
                    continue
                before = pickle.dumps(state, 5) if fresh and not warming else None
                state, r = step(state, v if len(value) > 1 else v[0])
                if not warming:
                    fresh = False
                    which.append(i)
                    got.append(r)
                    first.append(before)
                    last.append(None)
            if which:
                if held is not None:
                    yield done(held)
                held = (batch, which, got, first, last)
        if held is not None:
            if not fresh:
                held[4][-1] = pickle.dumps(state, 5)
            yield done(held)

    def folded(part: DataFrame) -> DataFrame:
        return written(part.repartition(*[F.col(c) for c in runs]).sortWithinPartitions(*runs, "__rn").mapInArrow(run, schema), "fold-part")

    def borders(part: DataFrame) -> DataFrame:
        ends = part.where(F.col("__first").isNotNull() | F.col("__last").isNotNull()).groupBy(*names)
        return ends.agg(F.first("__first", True).alias("__first"), F.first("__last", True).alias("__last"))

    parts, rounds = [folded(rows)], 1
    known = written(borders(parts[0]), "fold-borders")
    while True:
        w = Window.partitionBy(*stream).orderBy("__piece")
        wrong = known.withColumn("__given", F.lag("__last").over(w)).withColumn("__wrong", F.coalesce(F.col("__given") != F.col("__first"), F.lit(False)))
        n = wrong.where("__wrong").count()
        log_info(f"fold in pieces of {piece_rows} rows, round {rounds}: {n} pieces to fold again")
        if not n:
            return functools.reduce(DataFrame.unionByName, parts).select(*kept, out), rounds
        if n <= SIDE_BY_SIDE and rounds <= SIDE_BY_SIDE:
            wrong = wrong.where("__wrong").withColumns({"__head": F.lit(True), "__run": F.col("__piece")})
        else:
            wrong = wrong.withColumn("__again", F.coalesce(F.col("__piece") - F.max(F.when(F.col("__wrong"), F.col("__piece"))).over(w) < 2**rounds, F.lit(False)))
            wrong = wrong.withColumn("__head", F.col("__again") & ~F.lag("__again", 1, False).over(w))
            wrong = wrong.withColumn("__run", F.max(F.when(F.col("__head"), F.col("__piece"))).over(w)).where("__again")
        wrong = written(wrong.select(*names, "__run", F.when(F.col("__head"), F.col("__given")).alias("__given")), "fold-wrong")
        rounds += 1
        few = wrong.select(*names, "__run")
        few = F.broadcast(few) if wrong.count() <= MOST_PIECES else few
        again = _same(rows.where("not __warm").drop("__run"), few, names, "inner", "__run")
        empty = [F.lit(None).cast(df.schema[c].dataType).alias(c) if c not in stream else F.col(c) for c in df.columns]
        heads = wrong.where("__given is not null")
        states = heads.select(*empty, F.lit(0).cast("bigint").alias("__rn"), "__piece", F.lit(False).alias("__warm"), F.col("__given").alias("__state"), "__run")
        new = folded(again.select(*columns).unionByName(states.select(*columns)))
        parts = [*(_same(part, few, names, "left_anti") for part in parts), new]
        known = written(_same(known, few, names, "left_anti").unionByName(borders(new)), "fold-borders")


#: Wrong pieces, and rounds, up to which each piece is folded again on its own.
SIDE_BY_SIDE = 8
#: Pieces to fold again that are sent to all executors; counted first, more are joined with a shuffle.
MOST_PIECES = 50_000


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str, *more: str) -> DataFrame:
    """A join on columns that may hold nulls; of the right side only the columns `more` stay."""
    a, b = left.alias("__a"), right.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(names)], *more)
    on = functools.reduce(lambda x, y: x & y, [F.col(f"__a.{c}").eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(names)])
    return a.join(b, on, how).select("__a.*", *more)


def is_near(kept: list[int], h: int, bits: int) -> bool:
    return any(((h ^ k) & 0xFFFFFFFFFFFFFFFF).bit_count() <= bits for k in kept)


def remembered(kept: list[int], h: int, window: int) -> list[int]:
    """The last `window` accepted hashes."""
    return [*kept, h][-window:] if window > 0 else []


def dedup_window(df: DataFrame, stream: list[str], order: list[str], hash_col: str = "hash", window: int = DEDUP_WINDOW, bits: int = DEDUP_BITS, out: str = "is_duplicate", piece_rows: int | None = None) -> DataFrame:
    """A row is a duplicate if its hash is within `bits` of one of the last `window` accepted hashes; duplicates are not remembered."""

    def step(kept: list, h: int):
        return (kept, True) if is_near(kept, h, bits) else (remembered(kept, h, window), False)

    if piece_rows:
        return fold_in_pieces(df.withColumn("__h", F.col(hash_col)), stream, order, list, step, ["__h"], out, T.BooleanType(), piece_rows, min(12 * window, piece_rows))[0]
    return ordered_fold(df, stream, order, list, step, hash_col, out, T.BooleanType())


def sample_interval(df: DataFrame, stream: list[str], order: list[str], seconds_col: str, interval: float = SAMPLE_SECONDS, out: str = "accepted", piece_rows: int | None = None) -> DataFrame:
    """A row is accepted if at least `interval` has passed since the last accepted one; the first is."""
    step = lambda last, t: (t, True) if last is None or t - last >= interval else (last, False)
    if piece_rows:
        return fold_in_pieces(df.withColumn("__t", F.col(seconds_col)), stream, order, lambda: None, step, ["__t"], out, T.BooleanType(), piece_rows, min(256, piece_rows))[0]
    return ordered_fold(df, stream, order, lambda: None, step, seconds_col, out, T.BooleanType())


def with_motion(df: DataFrame, stream: list[str], order: list[str], pixels: str, delta: float = MOTION_DELTA, least: int = MOTION_PIXELS, first: int = FIRST_SCORE) -> DataFrame:
    """motion_score against the previous row that got here (whether it moved or not) and has_motion; the first row moves."""
    from skywright.functions.exprs import changed_elements

    w = Window.partitionBy(*stream).orderBy(*order)
    out = df.withColumn("__previous", F.lag(pixels).over(w))
    out = out.withColumn("motion_score", F.when(F.col("__previous").isNull(), F.lit(first).cast("bigint")).otherwise(changed_elements(F.col("__previous"), F.col(pixels), delta)))
    return out.withColumn("has_motion", F.col("__previous").isNull() | (F.col("motion_score") > least)).drop("__previous")


def cut_points(df: DataFrame, key: str, pieces: int, each: int = 100) -> list:
    """At most pieces - 1 values of key that cut df into about equal pieces, from a sample by hash of about pieces * each different values."""
    share = min(1.0, pieces * each / max(df.count(), 1))
    some = df.select(key).where(F.col(key).isNotNull())
    if share < 1:
        some = some.where(F.xxhash64(key) < F.lit(int(share * 2.0**64) - 2**63))
    got = sorted(r[0] for r in some.distinct().collect())
    return sorted({got[len(got) * k // pieces] for k in range(1, pieces)}) if got else []


def piece_of(key: Column, cuts: list) -> Column:
    """Number of the cuts that are not above key, by halving; 0 for null."""
    if not cuts:
        return F.lit(0)

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key >= F.lit(cuts[mid]), part(mid + 1, high)).otherwise(part(low, mid))

    return part(0, len(cuts))


def numbered(df: DataFrame, stream: list[str], order: list[str | Column], out: str = "rn", pieces: int = 1) -> DataFrame:
    """df with `out`: the row's number in its stream, from 1. With more pieces, the first order column is cut into ranges that are numbered
    in tasks of their own, plus the rows of the stream's ranges before; for few and long streams."""
    if pieces <= 1 or not isinstance(order[0], str):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*stream).orderBy(*order)).cast("bigint"))
    keyed = df.withColumn("__piece", piece_of(F.col(order[0]), cut_points(df, order[0], pieces)))
    names = [f"__s{i}" for i in range(len(stream))]
    counts = keyed.groupBy(*[F.col(c).alias(n) for c, n in zip(stream, names, strict=True)], F.col("__piece").alias("__p")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    same = F.col("__piece") == F.col("__p")
    for c, n in zip(stream, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    number = F.row_number().over(Window.partitionBy(*stream, "__piece").orderBy(*order)) + F.col("__before")
    return keyed.join(counts, same).withColumn(out, number.cast("bigint")).select(*df.columns, out)


def running(df: DataFrame, stream: list[str], order: list[str], sums: dict[str, Column], pieces: int = 1) -> DataFrame:
    """df with running sums (output name -> expression) in order within a stream, each row's own included. Pieces: see numbered().

    The sums of a stream's earlier ranges are a row for each range; they are added to the sums inside the row's own range.
    """
    values = {f"__v{i}": v for i, v in enumerate(sums.values())}
    keyed = df.withColumn("__piece", piece_of(F.col(order[0]), cut_points(df, order[0], pieces)) if pieces > 1 else F.lit(0)).withColumns(values)
    own = Window.partitionBy(*stream, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if pieces <= 1:
        return keyed.withColumns({name: F.sum(v).over(own) for name, v in zip(sums, values, strict=True)}).select(*df.columns, *sums)
    names = [f"__s{i}" for i in range(len(stream))]
    totals = keyed.groupBy(*[F.col(c).alias(n) for c, n in zip(stream, names, strict=True)], F.col("__piece").alias("__p")).agg(*[F.sum(v).alias(f"{v}_sum") for v in values])
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*names, "__p", *[F.coalesce(F.sum(f"{v}_sum").over(before), F.lit(0)).alias(f"{v}_before") for v in values])
    same = F.col("__piece") == F.col("__p")
    for c, n in zip(stream, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return keyed.join(totals, same).withColumns({name: F.sum(v).over(own) + F.col(f"{v}_before") for name, v in zip(sums, values, strict=True)}).select(*df.columns, *sums)


def numbered_batches(df: DataFrame, stream: list[str], order: list[str | Column], size: int = BATCH, pieces: int = 1) -> DataFrame:
    """rn (from 1) and batch_id (from 0) by count; pieces: see numbered()."""
    return numbered(df, stream, order, "rn", pieces).withColumn("batch_id", F.floor((F.col("rn") - 1) / size).cast("bigint"))


def batch_status(size: int = BATCH) -> Column:
    return F.when(F.col("rn") % size == 0, "batch_ready").otherwise("waiting_for_batch")


def batches(df: DataFrame, stream: list[str], order: list[str], members: dict[str, str], size: int = BATCH, keep_partial: bool = False, pieces: int = 1) -> DataFrame:
    """One row a batch with parallel arrays of its members in order (members: output name -> column); incomplete ones only if asked for."""
    rows = numbered_batches(df, stream, order, size, pieces)
    got = rows.groupBy(*stream, "batch_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rn", *[F.col(c).alias(a) for a, c in members.items()]))).alias("__m"))
    got = got if keep_partial else got.where(F.col("n") == size)
    part = lambda a: F.transform("__m", lambda m: m[a]).alias(a)
    return got.select(*stream, "batch_id", "n", *[part(a) for a in members])


def exact_split(df: DataFrame, name: str, seed: int = SPLIT_SEED, train: float = TRAIN, val: float = VAL, buckets: int = 4096) -> DataFrame:
    """df with `split`: the first int(n * train) names in hashed order are train, the next int(n * val) val, the rest test.

    The order is md5("seed:name"), then the name. Ranks are made in buckets of the hash's first bits: a window in each bucket plus the
    number of rows in earlier buckets, from one count a bucket (at most `buckets` rows are broadcast), so no task sees all rows.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(name)))
    keyed = df.withColumn("__key", key).withColumn("__bucket", F.floor(F.conv(F.substring("__key", 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))
    counts = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__total"))
    ranked = keyed.join(F.broadcast(offsets), "__bucket").withColumn("__rank", F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", name)) + F.col("__before"))
    n_train, n_val = F.floor(F.col("__total") * F.lit(train)), F.floor(F.col("__total") * F.lit(val))
    split = F.when(F.col("__rank") <= n_train, "train").when(F.col("__rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).select(*df.columns, "split")


def last_row(df: DataFrame, value: str, order: str) -> DataFrame:
    """Number of rows, and the value of the last one in order."""
    return df.agg(F.count("*").alias("n"), F.max_by(value, order).alias("last_value"))
