"""Inference over ready batches: a pluggable detector, nested detections, greedy suppression."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywright.functions import exprs
from skywright.sources.schemas import DETECTION

#: Overlap above which a weaker box of the same class goes, and boxes kept for an image.
NMS_IOU, MAX_DETECTIONS = 0.7, 300


def detect(frames: DataFrame, model: Callable[[], Callable[[list[bytes]], list[list[dict]]]], batch: int = 4) -> DataFrame:
    """frames (image_path, data) with detections. model() is called once a worker task and returns images -> detections."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T.ArrayType(DETECTION)

    def run(batches):
        infer = model()
        for b in batches:
            paths, data = b.column(0), b.column(1).to_pylist()
            out = [d or [] for i in range(0, len(data), batch) for d in infer(data[i : i + batch])]
            yield pa.RecordBatch.from_arrays([paths, pa.array(out, to_arrow_type(kind))], ["image_path", "detections"])

    return frames.select("image_path", "data").mapInArrow(run, T.StructType([T.StructField("image_path", T.StringType()), T.StructField("detections", kind)]))


def nested_detections(boxes: DataFrame, image: str, order: list[str]) -> DataFrame:
    """One row an image with its detections in order; boxes: image, order columns, class_id, confidence, bbox."""
    got = boxes.groupBy(image).agg(F.sort_array(F.collect_list(F.struct(*order, exprs.detection(F.col("class_id"), F.col("confidence"), F.col("bbox")).alias("d")))).alias("ds"))
    return got.select(image, F.transform("ds", lambda x: x["d"]).alias("detections"))


def with_metadata(batches: DataFrame, predictions: str, metadata: str) -> DataFrame:
    """A row for each prediction with the metadata at its place; the longer list is cut."""
    pairs = exprs.zip_shorter(F.col(predictions), F.col(metadata), "detections", "metadata")
    return batches.select("*", F.explode(pairs).alias("__p")).select(*[c for c in batches.columns if c not in (predictions, metadata)], "__p.metadata", "__p.detections")


def envelope(results: DataFrame) -> DataFrame:
    """status completed with the results of a batch; other rows pass as they are."""
    return results.withColumn("status", F.when(F.col("status") == "batch_ready", "completed").otherwise(F.col("status")))


#: Boxes of an image up to which plain loops are quicker than arrays.
FEW = 24


def _kept(classes: list, boxes: list, threshold: float) -> list[bool]:
    """Which boxes of an image stay, in their order: those that no kept box of their class before them overlaps by more than threshold."""
    import numpy as np

    n = len(boxes)
    if n <= FEW:
        kept: list[int] = []
        for i in range(n):
            if not any(classes[k] == classes[i] and _overlap(boxes[k], boxes[i]) > threshold for k in kept):
                kept.append(i)
        stay = set(kept)
        return [i in stay for i in range(n)]
    no_box = [0.0] * 4
    at = np.array([b if b is not None and len(b) == 4 else no_box for b in boxes], np.float64)
    x1, y1, x2, y2 = at.T
    codes = np.unique(np.array([str(c) for c in classes]), return_inverse=True)[1]
    area, alive, out = (x2 - x1) * (y2 - y1), np.ones(n, bool), np.zeros(n, bool)
    # By the left edge, so that a kept box meets only those that begin before it ends.
    order = np.argsort(x1, kind="stable")
    left, widest = x1[order], float((x2 - x1).max())
    for i in range(n):
        if not alive[i]:
            continue
        out[i] = True
        near = order[np.searchsorted(left, x1[i] - widest) : np.searchsorted(left, x2[i], "right")]
        near = near[alive[near] & (codes[near] == codes[i]) & (near > i)]
        inter = np.maximum(np.minimum(x2[i], x2[near]) - np.maximum(x1[i], x1[near]), 0.0) * np.maximum(np.minimum(y2[i], y2[near]) - np.maximum(y1[i], y1[near]), 0.0)
        union = area[i] + area[near] - inter
        alive[near[(np.divide(inter, union, out=np.zeros_like(inter), where=union > 0) > threshold)]] = False
    return out.tolist()


def _overlap(a: list | None, b: list | None) -> float:
    if a is None or b is None or len(a) != 4 or len(b) != 4:
        return 0.0
    inter = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def suppress(boxes: DataFrame, image: str, order: list[str], threshold: float = NMS_IOU) -> DataFrame:
    """boxes with `kept`: greedy suppression in order within an image, among boxes of the same class. bbox: corners; class_id.

    Rows are dealt by image and sorted, one shuffle; a task holds the boxes of one image at a time. In a crowded image a kept box is compared
    with the boxes that can reach it along the first axis. A box without four corners overlaps nothing.
    """
    import pyarrow as pa

    names = boxes.columns
    at = {c: names.index(c) for c in (image, "class_id", "bbox")}
    schema = T.StructType([*boxes.schema.fields, T.StructField("kept", T.BooleanType())])

    def run(batches):
        left = None
        for batch in itertools.chain(batches, [None]):  # the last image of a batch waits for the next batch
            if batch is not None:
                left = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if left is None or not left.num_rows:
                continue
            left = left.combine_chunks()
            keys, classes, corners = (left.column(at[c]).to_pylist() for c in (image, "class_id", "bbox"))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            if batch is not None:
                cuts.pop()
            marks = [m for a, b in itertools.pairwise(cuts) for m in _kept(classes[a:b], corners[a:b], threshold)]
            for part in left.slice(0, cuts[-1]).append_column("kept", pa.array(marks, pa.bool_())).to_batches():
                yield part
            left = left.slice(cuts[-1])

    return boxes.repartition(image).sortWithinPartitions(image, *order).mapInArrow(run, schema)
