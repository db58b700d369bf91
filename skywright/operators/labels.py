"""Box annotations: conversion to normalised label rows and lines, pixel corners, splits, class counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skywright.functions import exprs


def image_lookup(images: DataFrame, last_by: str | None = None) -> DataFrame:
    """One row an id; of rows that repeat an id the last by `last_by` wins (any, without an order)."""
    if last_by is None:
        return images.select("id", "file_name", "width", "height").dropDuplicates(["id"])
    return images.groupBy("id").agg(F.max_by(F.struct("file_name", "width", "height"), last_by).alias("i")).select("id", "i.*")


def to_yolo(annotations: DataFrame, images: DataFrame, strict: bool = False) -> DataFrame:
    """image_id, file_name, class_id, the normalised box and the image's width and height of every usable annotation.

    annotations: image_id, category_id, damage_bbox; images: one row an id. An annotation of an unknown image is dropped, or an error if strict.
    """
    usable = annotations.where(exprs.usable_box(F.col("damage_bbox")))
    if strict:
        known = annotations.join(images.select(F.col("id").alias("image_id"), F.lit(True).alias("__known")), "image_id", "left")
        usable = known.where(F.assert_true(F.col("__known").isNotNull(), F.lit("annotation of an unknown image")).isNull()).where(exprs.usable_box(F.col("damage_bbox"))).drop("__known")
    both = usable.join(images, usable["image_id"] == images["id"])
    return both.select("image_id", "file_name", exprs.class_of(F.col("category_id")).alias("class_id"), *exprs.normalised_box(F.col("damage_bbox"), F.col("width"), F.col("height")), "width", "height")


def label_lines(rows: DataFrame) -> DataFrame:
    """rows with `line`: class and box with six decimals, rounded as C's printf does (half to even on the exact binary value)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    names = rows.columns
    at = [names.index(c) for c in ("class_id", "xc", "yc", "w", "h")]

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in at]
            lines = ["%d %.6f %.6f %.6f %.6f" % r for r in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines, pa.string())], [*names, "line"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("line", T.StringType())]))


def label_files(lines: DataFrame, images: DataFrame, order: str = "line") -> DataFrame:
    """One row a label file with its whole text; images without annotations have an empty file, and images with equal stems share one."""
    stems = images.select(exprs.stem(F.col("file_name")).alias("stem")).distinct()
    text = lines.select(exprs.stem(F.col("file_name")).alias("stem"), F.struct(F.col(order).alias("o"), "line").alias("l")).groupBy("stem").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    joined = stems.join(text, "stem", "left")
    body = F.array_join(F.transform("ls", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return joined.select("stem", F.coalesce(body, F.lit("")).alias("text"))


def boxes_per_image(yolo: DataFrame, images: DataFrame) -> DataFrame:
    """Every image with its number of boxes, 0 included; counted before the join."""
    counts = yolo.groupBy("image_id").agg(F.count("*").alias("n"))
    return images.select(F.col("id").alias("image_id")).join(counts, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_boxes"))


def parse_label_text(texts: DataFrame) -> DataFrame:
    """Label rows from columns stem, line_no, value (a line); fields are cut at runs of white space."""
    f = F.split(F.trim("value"), r"\s+")
    num = lambda i: F.get(f, i).cast("double")
    return texts.where(F.trim("value") != "").select("stem", "line_no", num(0).cast("int").alias("class_id"), num(1).alias("xc"), num(2).alias("yc"), num(3).alias("w"), num(4).alias("h"))


def matched_labels(images: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """images with has_label; an image without a label file stays."""
    have = labels.select(key).distinct().withColumn("__l", F.lit(True))
    return images.join(have, key, "left").withColumn("has_label", F.col("__l").isNotNull()).drop("__l")


def labelled_images(images: DataFrame, rows: DataFrame) -> DataFrame:
    """Images (file_name and more) with the rows of the label file of the same stem; images without one are left out."""
    return images.withColumn("stem", exprs.stem(F.col("file_name"))).join(rows, "stem")


def class_histogram(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def top_detections(boxes: DataFrame, image: str, score: str, tie: list[str], most: int = 300) -> DataFrame:
    """The best `most` boxes of each image."""
    w = Window.partitionBy(image).orderBy(F.desc(score), *tie)
    return boxes.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most)
