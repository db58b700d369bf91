"""The completion report: one row a check, and whether all gating checks pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywright.sources.storage import exists, glob_count

SCHEMA = "check_id string, name string, ok boolean, details string, gating boolean"


@dataclass(frozen=True)
class Layout:
    """Where a dataset's artefacts are expected."""

    root: str
    instances: str = "processed/annotations/instances.json"
    images: str = "processed/images"
    posts: str = "processed/labels.jsonl"
    all_images: str = "yolo/all/images"
    all_labels: str = "yolo/all/labels"
    classes: str = "yolo/classes.txt"
    train_images: str = "yolo/train/images"
    train_labels: str = "yolo/train/labels"
    val_images: str = "yolo/val/images"
    val_labels: str = "yolo/val/labels"
    descriptor: str = "yolo/data.yaml"
    run: str = "runs/train"
    weights: str = "runs/train/weights/best.pt"
    metrics: str = "runs/train/results.csv"

    def path(self, field: str) -> str:
        return f"{self.root.rstrip('/')}/{getattr(self, field)}"


def report(spark: SparkSession, at: Layout) -> DataFrame:
    """All checks of a dataset's folders, through Hadoop's file systems."""
    here = lambda f: exists(spark, at.path(f))
    many = lambda f, *ext: sum(glob_count(spark, f"{at.path(f)}/*.{e}") for e in ext)
    details = ""
    if here("instances"):
        from skywright.sources.files import coco_document

        doc = coco_document(spark, at.path("instances"))
        size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        i, a, c = doc.select(size("images"), size("annotations"), size("categories")).first()
        details = f"{i} images, {a} annotations, {c} categories"
    names = spark.read.text(at.path("classes")).where(F.trim("value") != "").count() if here("classes") else 0
    epochs, metric = 0, None
    if here("metrics"):
        from skywright.sources.files import csv_table

        epochs, metric = last_metric(csv_table(spark, at.path("metrics"))).first()
    rows = [
        ("V1", "COCO annotations merged", here("instances"), details, True),
        ("V2", "Images copied to processed", here("images"), f"{many('images', 'jpg', 'png')} images", True),
        ("V3", "Labels JSONL created", here("posts"), "", True),
        ("V4", "YOLO images in all/", here("all_images"), f"{many('all_images', 'jpg', 'png')} images", True),
        ("V5", "YOLO labels in all/", here("all_labels"), f"{many('all_labels', 'txt')} labels", True),
        ("V6", "Classes defined", here("classes"), f"{names} classes", True),
        ("V7", "Train images", here("train_images"), f"{many('train_images', 'jpg', 'png')} images", True),
        ("V8", "Train labels", here("train_labels"), f"{many('train_labels', 'txt')} labels", True),
        ("V9", "Val images", here("val_images"), f"{many('val_images', 'jpg', 'png')} images", True),
        ("V10", "Val labels", here("val_labels"), f"{many('val_labels', 'txt')} labels", True),
        ("V11", "data.yaml created", here("descriptor"), "", True),
        ("V12", "Training complete", here("run") and here("weights"), "", True),
        ("V13", "Metrics recorded", epochs > 0, f"{epochs} epochs, last mAP50 {metric}", False),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def last_metric(metrics: DataFrame, column: str = "metrics/mAP50(B)", epoch: str = "epoch") -> DataFrame:
    """Epochs, and the metric of the last one."""
    names = {c.strip(): c for c in metrics.columns}
    return metrics.agg(F.count("*").alias("epochs"), F.max_by(F.trim(F.col(f"`{names[column]}`")), F.trim(F.col(f"`{names[epoch]}`")).cast("int")).alias("metric"))


def all_good(checks: DataFrame) -> DataFrame:
    return checks.where("gating").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("complete"), F.count_if(~F.col("ok")).alias("n_failed"))


def printed(checks: DataFrame, width: int = 70) -> DataFrame:
    """The report as text: line_no and line, with a rule above and below, one line a check in order, and the verdict."""
    rule, mark = F.repeat(F.lit("="), F.lit(width)), lambda ok: F.when(ok, "\u2713").otherwise("\u2717")
    number = F.regexp_extract("check_id", "[0-9]+", 0).cast("int")
    body = F.concat(mark(F.col("ok")), F.lit(" "), F.col("name"), F.when(F.col("details") != "", F.concat(F.lit(" - "), F.col("details"))).otherwise(""))
    one = lambda n, text: all_good(checks).select(F.lit(n).alias("line_no"), text.alias("line"))
    verdict = F.concat(mark(F.col("complete")), F.when(F.col("complete"), " PIPELINE EXECUTION SUCCESSFUL").otherwise(" PIPELINE INCOMPLETE - Some stages failed or are missing"))
    return one(0, rule).unionByName(checks.select(number.alias("line_no"), body.alias("line"))).unionByName(one(10_000, verdict)).unionByName(one(10_001, rule))
