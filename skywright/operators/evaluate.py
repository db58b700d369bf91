"""Evaluation of detections against ground truth: matches by overlap, precision-recall curves and average precision by class.

A detection takes the ground-truth box of its image and class that it overlaps most; at a threshold, a box is found by the most confident
of the detections that take it with at least that overlap. Detections are then ranked by confidence within their class over all images. Average
precision is the area below the envelope of precision, read off at recalls 0, 0.01, ... 1 with straight lines between points, a point
(recall 0, precision 1) before and a point (1, 0) after the curve; a class without ground truth is left out of the means.

One shuffle by image and class pairs the boxes, and one by class and range of confidence ranks them, so few classes still fill many tasks. Of
each range between two grid recalls only the first rank and the best precision are kept, by partial aggregation: a table of 101 rows for each class and
threshold is all that meets in windows.

Defined cases: a class without detections has precision 0; detections of a class without ground truth count for no mean; boxes without area
overlap nothing; equal overlaps go to the first box in the order of its columns, equal confidences by the order given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skywright.functions import exprs
from skywright.operators import ordered

#: Overlaps at which a detection can count.
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
GRID = 100


def matched(detections: DataFrame, truth: DataFrame, image: str, order: list[str]) -> DataFrame:
    """Every detection (image, class_id, order) with iou, its overlap with the box it takes, and before, the most of earlier ones with that box.

    detections: image, class_id, bbox (corners) and columns that order an image's detections (most confident first); truth: image, class_id, bbox.
    At a threshold t the detection finds its box if before < t <= iou.
    """
    boxes = truth.select(F.col(image).alias("__i"), F.col("class_id").alias("__c"), F.col("bbox").alias("__box"))
    pairs = detections.join(boxes, (F.col(image) == F.col("__i")) & (F.col("class_id") == F.col("__c")), "left")
    overlap = F.coalesce(exprs.iou(F.col("bbox"), F.col("__box")), F.lit(0.0))
    taken = pairs.groupBy(image, "class_id", *[c for c in order if c != image]).agg(F.min(F.struct((-overlap).alias("less"), "__box")).alias("__best"))
    taken = taken.withColumn("iou", -F.col("__best.less")).withColumn("__box", F.col("__best.__box"))
    earlier = Window.partitionBy(image, "class_id", "__box").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return taken.withColumn("before", F.coalesce(F.max("iou").over(earlier), F.lit(0.0))).select(image, "class_id", *[c for c in order if c != image], "iou", "before")


def _hits(rows: DataFrame, order: list[str], thresholds: tuple, pieces: int) -> DataFrame:
    """class_id, t (number of the threshold), m (how many boxes are found up to here) and rank of every detection that finds a box."""
    sums = {"rank": F.lit(1)} | {f"m{k}": ((F.col("before") < t) & (F.col("iou") >= t)).cast("int") for k, t in enumerate(thresholds)}
    ranked = ordered.running(rows, ["class_id"], order, sums, pieces)
    finds = F.array(*[F.struct(F.lit(k).alias("t"), ((F.col("before") < t) & (F.col("iou") >= t)).alias("hit"), F.col(f"m{k}").alias("m")) for k, t in enumerate(thresholds)])
    return ranked.select("class_id", "rank", F.explode(F.filter(finds, lambda x: x["hit"])).alias("x")).select("class_id", "x.t", "x.m", "rank")


def _precision(i: Column, n: Column, all_: Column, found: Column, first: Column, best: Column) -> Column:
    """Interpolated precision at recall i / GRID. n: boxes, all_: detections, found: boxes found in all; first: rank at which one
    box more than this recall is found, best: best precision from there on."""
    k = F.floor(i * n / GRID)
    here = F.when((k == 0) & (first == 1), 1.0).otherwise(F.greatest(F.when(first > 1, k / (first - 1)), best))
    inside = here + (i / GRID - k / n) * n * (best - here)
    last = found / F.greatest(all_, F.lit(1))
    beyond = F.when((i == GRID) | (found == n), 0.0).otherwise(last * (1 - (i / GRID - found / n) / (1 - found / n)))
    return F.when(i == GRID, 0.0).when(k < found, inside).otherwise(beyond)


def average_precision(detections: DataFrame, truth: DataFrame, image: str, order: list[str], thresholds: tuple = THRESHOLDS, pieces: int = 16) -> DataFrame:
    """class_id, threshold, n_truth, n_detections, n_found and ap of every class with ground truth, for each threshold.

    The first column of `order` is a number by which detections of all images are ranked, least first (minus the confidence).
    """
    rows = matched(detections, truth, image, order)
    classes = truth.groupBy("class_id").agg(F.count("*").alias("n_truth"))
    counts = detections.groupBy("class_id").agg(F.count("*").alias("n_detections"))
    classes = classes.join(counts, "class_id", "left").select("class_id", "n_truth", F.coalesce("n_detections", F.lit(0)).cast("bigint").alias("n_detections"))
    hits = _hits(rows, order, thresholds, pieces).join(classes.select("class_id", "n_truth"), "class_id")
    i = F.ceil(GRID * F.col("m") / F.col("n_truth")).cast("int") - 1  # the last grid recall that is below m boxes
    parts = hits.groupBy("class_id", "t", i.alias("i")).agg(F.max(F.col("m") / F.col("rank")).alias("best"), F.min("rank").alias("first"), F.count("*").alias("hits"))
    grid = classes.select("*", F.posexplode(F.array(*map(F.lit, thresholds))).alias("t", "threshold")).select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("i"))
    on = Window.partitionBy("class_id", "t").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy("class_id", "t")
    grid = grid.join(parts, ["class_id", "t", "i"], "left").select("class_id", "t", "threshold", "n_truth", "n_detections", "i", F.coalesce(F.sum("hits").over(whole), F.lit(0)).alias("n_found"), F.first("first", True).over(on).alias("first"), F.max("best").over(on).alias("best"))
    y = _precision(F.col("i"), F.col("n_truth"), F.col("n_detections"), F.col("n_found"), F.col("first"), F.col("best"))
    area = F.sum(F.when(F.col("i").isin(0, GRID), F.col("y") / 2).otherwise(F.col("y"))) / GRID
    return grid.withColumn("y", y).groupBy("class_id", "threshold", "n_truth", "n_detections").agg(F.max("n_found").alias("n_found"), area.alias("ap"))


def mean_precision(by_class: DataFrame) -> DataFrame:
    """map50 and map50_95: means over classes, at 0.5 and over all thresholds; n_classes."""
    per = by_class.groupBy("class_id").agg(F.avg("ap").alias("ap"), F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("ap50"))
    return per.agg(F.count("*").alias("n_classes"), F.avg("ap50").alias("map50"), F.avg("ap").alias("map50_95"))
