"""The frame pipeline: near-duplicate, size, motion, blur, batch; in two modes.

`intended` (the default) looks for duplicates once. `strict` looks twice, as the original loop does: the second look finds the frame's own
hash, so every frame that moves is a duplicate and no batch is ever ready. Each stateful stage sees only the survivors of the one before:
all of them are one fold over a stream in order, with one shuffle, so every frame has one status.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywright.operators import ordered

#: Shortest side and sharpness of a usable frame.
MIN_SIDE, MIN_SHARPNESS = 100, 100


def valid_size(height: Column, width: Column, least: int = MIN_SIDE) -> Column:
    return F.coalesce((height >= least) & (width >= least), F.lit(False))


def is_blurry(variance: Column, least: float = MIN_SHARPNESS) -> Column:
    return variance < least


def run_pipeline(
    frames: DataFrame, stream: list[str], order: list[str], key: str, mode: str = "intended", hash_col: str = "hash", valid: Column | None = None, pixels: str = "pixels", variance: Column | None = None,
    window: int = ordered.DEDUP_WINDOW, bits: int = ordered.DEDUP_BITS, delta: float = ordered.MOTION_DELTA, least_motion: int = ordered.MOTION_PIXELS, sharpness: float = MIN_SHARPNESS, batch: int = ordered.BATCH,
    piece_rows: int | None = None, pieces: int = 32,
) -> DataFrame:
    """stream, key, status, reason, motion_score and batch_id of every frame.

    With `piece_rows` long streams are folded in pieces (see ordered.fold_in_pieces); the fold does not count then, and the frames that reach a batch are
    numbered by running sums over `pieces` ranges.
    """
    if mode not in ("intended", "strict"):
        raise ValueError(f"mode is 'intended' or 'strict', not {mode!r}")
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else valid_size(F.col("height"), F.col("width"))
    sharp = variance if variance is not None else F.col("laplacian_var")
    seen = frames.select(*dict.fromkeys([*stream, *order, key]), F.col(hash_col).alias("__h"), F.col(pixels).alias("__pixels"), ok.alias("__ok"), sharp.cast("double").alias("__v"))

    def step(state: tuple, frame: tuple):
        (kept, previous, n), (h, image, good, sharpness_of) = state, frame
        if ordered.is_near(kept, h, bits):
            return state, ("skipped", "duplicate", None, None)
        kept = ordered.remembered(kept, h, window)
        if not good:
            return (kept, previous, n), ("skipped", "invalid_image", None, None)
        score = None if previous is None else int((np.abs(image.astype(np.int64) - previous) > delta).sum())
        previous = image.astype(np.int64)
        if score is not None and score <= least_motion:
            return (kept, previous, n), ("skipped", "no_motion", score, None)  # the only outcome that carries its score
        if mode == "strict":
            return (kept, previous, n), ("skipped", "duplicate", None, None)
        if sharpness_of < sharpness:
            return (kept, previous, n), ("skipped", "blurry", None, None)
        return (kept, previous, n + 1), ("batch_ready" if (n + 1) % batch == 0 else "waiting_for_batch", None, None, n // batch)

    def named(state: tuple, frame: tuple):
        state, result = step(state, frame)
        return state, dict(zip(("status", "reason", "motion_score", "batch_id"), result, strict=True))

    def uncounted(state: tuple, frame: tuple):
        (kept, previous, _), result = named((*state, 0), frame)
        return (kept, previous), result

    kind = T.StructType([T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("motion_score", T.LongType()), T.StructField("batch_id", T.LongType())])
    if piece_rows:
        folded, _ = ordered.fold_in_pieces(seen, stream, order, lambda: ([], None), uncounted, ["__h", "__pixels", "__ok", "__v"], "__r", kind, piece_rows, min(12 * window, piece_rows))
        reached = F.col("__r.status") != "skipped"
        n = ordered.running(folded, stream, order, {"__n": reached.cast("int")}, pieces)
        status = F.when(reached, F.when(F.col("__n") % batch == 0, "batch_ready").otherwise("waiting_for_batch")).otherwise("skipped")
        number = F.when(reached, F.floor((F.col("__n") - 1) / batch).cast("bigint"))
        return n.select(*dict.fromkeys([*stream, key]), status.alias("status"), "__r.reason", "__r.motion_score", number.alias("batch_id"))
    folded = ordered.ordered_fold(seen, stream, order, lambda: ([], None, 0), named, ["__h", "__pixels", "__ok", "__v"], "__r", kind)
    return folded.select(*dict.fromkeys([*stream, key]), "__r.*")


def metadata(path: Column, height: Column, width: Column, channels: Column, side: int = 640) -> Column:
    from skywright.functions.exprs import processed_at

    return F.struct(path.alias("image_path"), F.lit("drone").alias("source"), processed_at().alias("processed_at"), F.array(height, width, channels).alias("original_size"), F.array(F.lit(side), F.lit(side), channels).alias("processed_size"))


def reason_report(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("reason", "status").alias("outcome")).agg(F.count("*").alias("n"))


def reduction(results: DataFrame) -> DataFrame:
    """Frames, frames that reached a batch, and by how many per cent the stream got shorter (in whole hundredths)."""
    kept = F.count_if(F.col("status") != "skipped")
    return results.agg(F.count("*").alias("total"), kept.alias("processed"), F.floor((1 - kept / F.greatest(F.count("*"), F.lit(1))) * 10000).cast("bigint").alias("reduction_bp"))
