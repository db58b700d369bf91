"""Readers: image folders, JSON lines, annotation documents, label files, tables, class lists, settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywright.functions import exprs
from skywright.sources import schemas
from skywright.sources.storage import exists


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    return [p for p in paths if exists(spark, p)]


def listing(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """path and length of the files of folders; contents are not read. Missing folders are empty; files without a byte, which hold no image, are left out."""
    found = _existing(spark, [paths] if isinstance(paths, str) else paths)
    if not found:
        return spark.createDataFrame([], "path string, length bigint")
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(found).select("path", "length")


def drone_images(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder).where(exprs.is_drone_image(F.col("path")))


def gis_images(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder).where(exprs.is_gis_image(F.col("path")))


def satellite_images(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All levels of all roots, with the pre/post mark of the directory."""
    return listing(spark, roots, recursive=True).where(exprs.is_satellite_image(F.col("path"))).withColumn("image_type", exprs.image_type(F.col("path")))


def sorted_frames(spark: SparkSession, folder: str, any_case: bool = False) -> DataFrame:
    """Frames with their names, ordered by name in binary collation."""
    name = exprs.base_name(F.col("path"))
    keep = exprs.is_drone_image(name) if any_case else exprs.is_frame_strict(name)
    return listing(spark, folder).withColumn("name", name).where(keep).orderBy("name")


def first_entry(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder).agg(F.min(exprs.base_name(F.col("path"))).alias("name"))


def images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Decoded images; what cannot be decoded stays as a row of height -1."""
    return spark.read.format("image").option("dropInvalid", "false").load(paths)


def social_posts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines; unknown keys are ignored, missing ones null. A malformed line is an error if strict, else a row of nulls."""
    return spark.read.schema(schemas.SOCIAL_INPUT).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def coco_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COCO).option("multiLine", "true").json(path)


def coco_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images (with their place `pos`), annotations, categories."""
    doc = coco_document(spark, path)
    part = lambda c: doc.select(F.posexplode(c).alias("pos", "x")).select("pos", "x.*")
    return part("images"), part("annotations").drop("pos"), part("categories").drop("pos")


def label_rows(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """Label rows of all `.txt` files of a folder, with stem and line number."""
    from skywright.operators.labels import parse_label_text

    text = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.txt").text(folder).select(exprs.stem(exprs.base_name(F.col("_metadata.file_path"))).alias("stem"), "value")
    lines = text.select("stem", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return parse_label_text(lines).select(F.lit(split).cast("string").alias("split"), "*")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header; all columns are strings."""
    return spark.read.option("header", "true").option("inferSchema", "false").csv(path)


def class_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where(F.col("name") != "")


def settings(spark: SparkSession, path: str) -> dict[str, object]:
    """Flat `key: value` settings with at most one nested map, as dataset descriptors and run configurations have."""
    out: dict = {}
    nested: dict | None = None
    for row in spark.read.text(path).collect():  # a configuration file
        m = re.match(r"^(\s*)([^:#\s][^:]*):\s*(.*?)\s*$", row[0].split(" #")[0])
        if not m:
            continue
        indent, key, value = m.groups()
        if value == "" and not indent:
            nested = out[key] = {}
        elif indent and nested is not None:
            nested[int(key) if key.isdigit() else key] = _scalar(value)
        else:
            out[key], nested = _scalar(value), None
    return {k: (v if v != {} else None) for k, v in out.items()}


def _scalar(text: str):
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("'\"")
