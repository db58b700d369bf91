"""Registered queries of readers, writers and the completion report, over folders that they write first.

A dataset's folders hold a few files for each nation and region, whatever the scale: 25 images, their annotations and label files. They
are written below the shared folder (all executors see it) and read back by the library's own readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywright.functions import exprs, images
from skywright.operators import frames, labels, ordered, verify, vision
from skywright.plans.catalogue import query
from skywright.sources import files, sinks
from skywright.sources.storage import run_dir

def _key():
    return F.col("n_nationkey")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _nation(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet")


def _region(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/region.parquet")


def _named(rows: DataFrame, *parts) -> DataFrame:
    """name and data of small text files: the first part's text is the name, and its bytes the data."""
    name = F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    return rows.select(name.alias("name"), F.encode(name, "UTF-8").alias("data"))


# A dataset of 25 annotated images.

_N = "WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r, n_name FROM nation) "
_BOX = "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 5 THEN [k * 3.0::DOUBLE, 5.5::DOUBLE, 1.0::DOUBLE] ELSE [k * 3.0::DOUBLE, 5.5::DOUBLE, k - 3.0::DOUBLE, 20.0::DOUBLE + r] END"


def _document(spark, d, path: str) -> None:
    """An annotation document: one JSON object, in one file."""
    n, r = _nation(spark, d), _region(spark, d)
    box = F.array(_key() * F.lit(3.0), F.lit(5.5), _key() - F.lit(3.0), F.lit(20.0) + F.col("n_regionkey"))
    box = F.when(_key() % 7 == 0, None).when(_key() % 11 == 5, F.array(_key() * F.lit(3.0), F.lit(5.5), F.lit(1.0))).otherwise(box)
    image = F.struct(_key().cast("bigint").alias("id"), F.concat(F.lit("n_"), _key().cast("string"), F.lit(".jpg")).alias("file_name"), (_key() + 600).cast("int").alias("width"), F.lit(480).alias("height"))
    note = F.struct(_key().cast("bigint").alias("image_id"), (F.col("n_regionkey") + 1).cast("int").alias("category_id"), box.alias("damage_bbox"))
    kind = F.struct((F.col("r_regionkey") + 1).cast("int").alias("id"), F.col("r_name").alias("name"))
    parts = n.select(image.alias("image"), note.alias("note")).unionByName(r.select(kind.alias("kind")), allowMissingColumns=True)
    lists = parts.agg(F.sort_array(F.collect_list("image")).alias("images"), F.collect_list("note").alias("annotations"), F.collect_list("kind").alias("categories"))
    lists.select(F.to_json(F.struct(*lists.columns)).alias("value")).coalesce(1).write.text(path)


_YOLO = _N + f", b AS (SELECT *, {_BOX} AS box FROM n), y AS (SELECT k, r, 600 + k AS width, box[1] AS x, box[2] AS y, box[3] AS w, box[4] AS h FROM b WHERE len(box) = 4 AND box[3] > 0 AND box[4] > 0) "


@query("coco_document", _N + f"SELECT k AS image_id, CAST(r + 1 AS INTEGER) AS category_id, {_BOX} AS damage_bbox FROM n")
def coco_document(spark, d):
    path = f"{_folder(spark, 'document')}/instances.json"
    _document(spark, d, path)
    return files.coco_tables(spark, path)[1]


@query("coco_document_sizes", "SELECT (SELECT count(*) FROM nation) AS images, (SELECT count(*) FROM nation) AS annotations, (SELECT count(*) FROM region) AS categories")
def coco_document_sizes(spark, d):
    path = f"{_folder(spark, 'document')}/instances.json"
    _document(spark, d, path)
    return files.coco_document(spark, path).select(*[F.size(c).cast("bigint").alias(c) for c in ("images", "annotations", "categories")])


@query("label_round_trip", _YOLO + """SELECT 'train' AS split, 'n_' || k AS stem, CAST(r AS INTEGER) AS class_id, CAST(printf('%.6f', (x + w / 2) / width) AS DOUBLE) AS xc, CAST(printf('%.6f', (y + h / 2) / 480) AS DOUBLE) AS yc,
  CAST(printf('%.6f', w / width) AS DOUBLE) AS w, CAST(printf('%.6f', h / 480) AS DOUBLE) AS h FROM y""")
def label_round_trip(spark, d):
    """Document -> label rows -> one file an image -> label rows."""
    folder = _folder(spark, "labels")
    _document(spark, d, f"{folder}/instances.json")
    pictures, notes, _ = files.coco_tables(spark, f"{folder}/instances.json")
    lookup = labels.image_lookup(pictures, "pos")
    lines = labels.label_lines(labels.to_yolo(notes, lookup, strict=True))
    sinks.write_label_files(labels.label_files(lines, lookup), f"{folder}/txt")
    return files.label_rows(spark, f"{folder}/txt", "train").drop("line_no")


# Folders of images.


def _pictures(spark, d, folder: str) -> None:
    """A PNG of one colour for each nation, gray and RGB in turn, and one file that is no image."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keys = b.column(0).to_pylist()
            data = [images.encode_png(np.full((90 + k, 100 + k, 3) if k % 2 else (90 + k, 100 + k), 5 * k, np.uint8)) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([f"p_{k}.png" for k in keys]), pa.array(data, pa.binary())], ["name", "data"])

    good = _nation(spark, d).select(_key().cast("int")).mapInArrow(run, "name string, data binary")
    sinks.write_files(good.unionByName(_named(spark.range(1), "bad.png")), folder)


@query("image_shapes", _N + "SELECT 'p_' || k || '.png' AS name, CAST(90 + k AS INTEGER) AS height, CAST(100 + k AS INTEGER) AS width, CASE WHEN k % 2 = 1 THEN 3 ELSE 1 END AS n_channels, TRUE AS decoded, 90 + k >= 100 AS valid, TRUE AS blurry FROM n UNION ALL SELECT 'bad.png', -1, -1, -1, FALSE, FALSE, NULL")
def image_shapes(spark, d):
    folder = _folder(spark, "pictures")
    _pictures(spark, d, folder)
    f = images.features(files.images(spark, folder))
    return f.select(exprs.base_name(F.col("origin")).alias("name"), "height", "width", "n_channels", "decoded", frames.valid_size(F.col("height"), F.col("width")).alias("valid"), frames.is_blurry(F.col("laplacian_var")).alias("blurry"))


@query("image_resized", _N + "SELECT 'p_' || k || '.png' AS name, 640 AS height, 640 AS width, CAST(640 * 640 * CASE WHEN k % 2 = 1 THEN 3 ELSE 1 END AS INTEGER) AS bytes, CAST(5 * k AS INTEGER) AS colour FROM n")
def image_resized(spark, d):
    folder = _folder(spark, "pictures")
    _pictures(spark, d, folder)
    r = images.resized(files.images(spark, folder))
    return r.select(exprs.base_name(F.col("origin")).alias("name"), "height", "width", F.octet_length("data").alias("bytes"), F.conv(F.hex(F.substring("data", 1000, 1)), 16, 10).cast("int").alias("colour"))


_NAMES = "CASE k % 5 WHEN 0 THEN 'f_' || k || '.jpg' WHEN 1 THEN 'f_' || k || '.JPG' WHEN 2 THEN 'f_' || k || '.png' WHEN 3 THEN 'f_' || k || '.Jpeg' ELSE 'f_' || k || '.txt' END"


def _mixed_folder(spark, d) -> str:
    folder = _folder(spark, "mixed")
    end = F.when(_key() % 5 == 0, ".jpg").when(_key() % 5 == 1, ".JPG").when(_key() % 5 == 2, ".png").when(_key() % 5 == 3, ".Jpeg").otherwise(".txt")
    sinks.write_files(_named(_nation(spark, d), "f_", _key(), end), folder)
    return folder


def _base(df: DataFrame) -> DataFrame:
    return df.select(exprs.base_name(F.col("path")).alias("name"))


@query("folder_drone", _N + f"SELECT name FROM (SELECT {_NAMES} AS name FROM n) WHERE lower(name) LIKE '%.jpg'")
def folder_drone(spark, d):
    return _base(files.drone_images(spark, _mixed_folder(spark, d)))


@query("folder_gis", _N + f"SELECT name FROM (SELECT {_NAMES} AS name FROM n) WHERE regexp_matches(lower(name), '[.](jpg|jpeg|png)$')")
def folder_gis(spark, d):
    return _base(files.gis_images(spark, _mixed_folder(spark, d)))


@query("folder_sorted_any_case", _N + f"SELECT name, row_number() OVER (ORDER BY name) AS place FROM (SELECT {_NAMES} AS name FROM n) WHERE lower(name) LIKE '%.jpg'")
def folder_sorted_any_case(spark, d):
    return ordered.numbered(files.sorted_frames(spark, _mixed_folder(spark, d), any_case=True).select("name"), [], ["name"], "place", pieces=4)


@query("folder_first_entry", _N + f"SELECT min({_NAMES}) AS name FROM n")
def folder_first_entry(spark, d):
    return files.first_entry(spark, _mixed_folder(spark, d))


@query("folder_satellite", _N + "SELECT 's_' || k || CASE WHEN k % 3 = 0 THEN '.tif' ELSE '.TIFF' END AS name, CASE k % 4 WHEN 0 THEN 'pre' WHEN 1 THEN 'post' WHEN 2 THEN 'pre' ELSE 'unknown' END AS image_type FROM n")
def folder_satellite(spark, d):
    """Two roots with folders inside, and one root that is missing."""
    folder = _folder(spark, "satellite")
    where = F.when(_key() % 4 == 0, "one/Pre_fire/").when(_key() % 4 == 1, "one/a/POST/").when(_key() % 4 == 2, "two/pre_and_post/").otherwise("two/")
    sinks.write_files(_named(_nation(spark, d), where, "s_", _key(), F.when(_key() % 3 == 0, ".tif").otherwise(".TIFF")), folder)
    found = files.satellite_images(spark, [f"{folder}/one", f"{folder}/two", f"{folder}/three"])
    return found.select(exprs.base_name(F.col("path")).alias("name"), "image_type")


_SPLIT = _N + """, r AS (SELECT k, row_number() OVER (ORDER BY md5('42:' || 'p_' || k || '.jpg'), 'p_' || k || '.jpg') AS rk, count(*) OVER () AS c FROM n),
s AS (SELECT k, CASE WHEN rk <= floor(c * 0.7::DOUBLE) THEN 'train' WHEN rk <= floor(c * 0.7::DOUBLE) + floor(c * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r) """


@query("split_copies", _SPLIT + "SELECT split, 'images' AS part, 'p_' || k || '.jpg' AS name FROM s UNION ALL SELECT split, 'labels', 'p_' || k || '.txt' FROM s WHERE k % 2 = 0")
def split_copies(spark, d):
    """Images and, where there is one, their label files, copied to their split's folders, as the folders list them."""
    folder, n = _folder(spark, "splits"), _nation(spark, d)
    sinks.write_files(_named(n, "p_", _key(), ".jpg"), f"{folder}/images")
    sinks.write_files(_named(n.where(_key() % 2 == 0), "p_", _key(), ".txt"), f"{folder}/labels")
    rows = ordered.exact_split(_named(n, "p_", _key(), ".jpg").select("name"), "name")
    path = lambda part, name: F.concat(F.lit(f"{folder}/{part}/"), name)
    rows = rows.select(path("images", F.col("name")).alias("image_path"), path("labels", exprs.label_file(F.col("name"))).alias("label_path"), "split")
    sinks.copy_splits(rows, f"{folder}/out").write.format("noop").mode("overwrite").save()
    at = F.split("path", "/")
    return files.listing(spark, f"{folder}/out", recursive=True).select(F.element_at(at, -3).alias("split"), F.element_at(at, -2).alias("part"), F.element_at(at, -1).alias("name"))


# Text sources.


@query("jsonl_posts", "SELECT CAST(r_regionkey AS VARCHAR) AS id, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE '' END AS text, CASE WHEN r_regionkey < 3 THEN 'flood' END AS hazard, 'twitter' AS source FROM region")
def jsonl_posts(spark, d):
    k, path = F.col("r_regionkey"), _folder(spark, "posts")
    post = F.struct(k.cast("string").alias("id"), F.when(k % 2 == 0, F.col("r_name")).alias("text"), F.when(k < 3, "flood").alias("hazard"), k.alias("extra"))
    _region(spark, d).select(F.to_json(post).alias("value")).write.text(path)
    rows = files.social_posts(spark, path)
    return rows.select(*exprs.social_message(F.col("id"), F.col("text"), F.col("hazard"), F.lit(0.0))).drop("timestamp")


@query("class_list", "SELECT r_name AS name FROM region")
def class_list(spark, d):
    path = _folder(spark, "classes")
    _region(spark, d).select(F.explode(F.array(F.concat(F.lit("  "), "r_name", F.lit(" ")), F.lit(""), F.lit("   "))).alias("value")).write.text(path)
    return files.class_list(spark, path)


def _metrics(spark, d, path: str) -> None:
    line = F.concat(F.col("r_regionkey").cast("string"), F.lit(", 0."), F.col("r_regionkey").cast("string"), F.lit("5"))
    text = _region(spark, d).agg(F.concat(F.lit("epoch, metrics/mAP50(B)\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n")).alias("text"))
    name, folder = path.rpartition("/")[2], path.rpartition("/")[0]
    sinks.write_files(text.select(F.lit(name).alias("name"), F.encode("text", "UTF-8").alias("data")), folder)


@query("metrics_csv", "SELECT count(*) AS epochs, '0.' || max(r_regionkey) || '5' AS metric FROM region")
def metrics_csv(spark, d):
    path = f"{_folder(spark, 'metrics')}/results.csv"
    _metrics(spark, d, path)
    return verify.last_metric(files.csv_table(spark, path))


def _descriptor(spark, d, path: str) -> None:
    """A dataset descriptor whose classes are the regions."""
    line = F.concat(F.lit("  "), F.col("r_regionkey").cast("string"), F.lit(": "), F.col("r_name"))
    text = _region(spark, d).agg(F.concat(F.lit("path: /data\ntrain: images/train\nnames:\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n")).alias("text"))
    name, folder = path.rpartition("/")[2], path.rpartition("/")[0]
    sinks.write_files(text.select(F.lit(name).alias("name"), F.encode("text", "UTF-8").alias("data")), folder)


@query("descriptor_names", "SELECT CAST(r_regionkey AS INTEGER) AS class_id, r_name AS name FROM region")
def descriptor_names(spark, d):
    path = f"{_folder(spark, 'descriptor')}/data.yaml"
    _descriptor(spark, d, path)
    return spark.createDataFrame(list(files.settings(spark, path)["names"].items()), "class_id int, name string")


# The completion report.

_TRAIN = "(SELECT count(*) FROM nation WHERE n_nationkey % 10 < 7)"
_VAL = "(SELECT count(*) FROM nation WHERE n_nationkey % 10 >= 7)"
_ALL, _FEW = "(SELECT count(*) FROM nation)", "(SELECT count(*) FROM region)"
_REPORT = f"""SELECT * FROM (VALUES
  ('V1', 'COCO annotations merged', TRUE, {_ALL} || ' images, ' || {_ALL} || ' annotations, ' || {_FEW} || ' categories', TRUE),
  ('V2', 'Images copied to processed', TRUE, {_ALL} || ' images', TRUE), ('V3', 'Labels JSONL created', TRUE, '', TRUE),
  ('V4', 'YOLO images in all/', TRUE, {_ALL} + {_FEW} || ' images', TRUE), ('V5', 'YOLO labels in all/', TRUE, {_ALL} || ' labels', TRUE),
  ('V6', 'Classes defined', TRUE, {_FEW} || ' classes', TRUE), ('V7', 'Train images', TRUE, {_TRAIN} || ' images', TRUE), ('V8', 'Train labels', TRUE, {_TRAIN} || ' labels', TRUE),
  ('V9', 'Val images', TRUE, {_VAL} || ' images', TRUE), ('V10', 'Val labels', FALSE, '0 labels', TRUE), ('V11', 'data.yaml created', TRUE, '', TRUE), ('V12', 'Training complete', TRUE, '', TRUE),
  ('V13', 'Metrics recorded', TRUE, {_FEW} || ' epochs, last mAP50 0.' || {_FEW} - 1 || '5', FALSE)) t(check_id, name, ok, details, gating)"""


def _report(spark, d) -> DataFrame:
    """The report of a whole dataset but for the labels of its validation split."""
    at, n = verify.Layout(_folder(spark, "dataset")), _nation(spark, d)
    put = lambda field, rows, *parts: sinks.write_files(_named(rows, *parts), at.path(field))
    one = lambda field: sinks.write_files(_named(spark.range(1), at.path(field).rpartition("/")[2]), at.path(field).rpartition("/")[0])
    train, val = n.where(_key() % 10 < 7), n.where(_key() % 10 >= 7)
    _document(spark, d, at.path("instances"))
    put("images", n, "p_", _key(), ".jpg")
    put("all_images", n, "p_", _key(), ".jpg")
    put("all_images", _region(spark, d), "r_", F.col("r_regionkey"), ".png")
    put("all_labels", n, "p_", _key(), ".txt")
    for field, rows, end in (("train_images", train, ".png"), ("train_labels", train, ".txt"), ("val_images", val, ".jpg")):
        put(field, rows, "p_", _key(), end)
    one("posts")
    one("weights")
    _region(spark, d).select(F.explode(F.array("r_name", F.lit(" "))).alias("value")).write.text(at.path("classes"))
    _descriptor(spark, d, at.path("descriptor"))
    _metrics(spark, d, at.path("metrics"))
    return verify.report(spark, at)


@query("verify_report", _REPORT)
def verify_report(spark, d):
    return _report(spark, d)


@query("verify_all", f"SELECT bool_and(ok) AS complete, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS n_failed FROM ({_REPORT}) WHERE gating")
def verify_all(spark, d):
    return verify.all_good(_report(spark, d))


@query("verify_printed", f"""WITH r AS ({_REPORT}) SELECT CAST(substr(check_id, 2) AS INTEGER) AS line_no, CASE WHEN ok THEN '\u2713' ELSE '\u2717' END || ' ' || name || CASE WHEN details <> '' THEN ' - ' || details ELSE '' END AS line FROM r
  UNION ALL SELECT 0, repeat('=', 70) UNION ALL SELECT 10000, '\u2717 PIPELINE INCOMPLETE - Some stages failed or are missing' UNION ALL SELECT 10001, repeat('=', 70)""")
def verify_printed(spark, d):
    return verify.printed(_report(spark, d))


# Detection.


@query("detector_batches", _N + "SELECT 'p_' || k AS image_path, [CAST(k AS INTEGER)][:CAST(k > 0 AS INTEGER)] AS classes, CASE WHEN k > 0 THEN [0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, CAST(k AS DOUBLE)] END AS box FROM n")
def detector_batches(spark, d):
    """A stand-in detector that reports an image's length: none for an empty one."""

    def model():
        return lambda data: [[{"class_id": len(x), "confidence": 0.5, "bbox": [0.0, 0.0, 1.0, float(len(x))]}] if x else None for x in data]

    rows = _nation(spark, d).select(F.concat(F.lit("p_"), _key().cast("string")).alias("image_path"), F.encode(F.repeat(F.lit("x"), _key().cast("int")), "UTF-8").alias("data"))
    found = vision.detect(rows, model)
    return found.select("image_path", F.transform("detections", lambda x: x["class_id"]).alias("classes"), F.get("detections", 0)["bbox"].alias("box"))
