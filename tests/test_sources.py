"""Readers, writers, label conversion and the completion report on generated folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skywright.functions import exprs
from skywright.operators import labels, verify, vision
from skywright.sources import files, sinks


def touch(path, text=""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_listings(spark, tmp_path):
    root = str(tmp_path)
    for n in ("a.jpg", "b.JPG", "c.png", "d.Jpeg", "e.txt"):
        touch(f"{root}/flat/{n}", "x")
    for n in ("x/Pre_fire/1.tif", "x/POST/2.TIFF", "x/pre_and_post/3.tif", "y/other/pre_4.tif", "y/other/5.jpg"):
        touch(f"{root}/{n}", "x")
    names = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    assert names(files.drone_images(spark, f"{root}/flat")) == ["a.jpg", "b.JPG"]
    assert names(files.gis_images(spark, f"{root}/flat")) == ["a.jpg", "b.JPG", "c.png", "d.Jpeg"]
    assert [r["name"] for r in files.sorted_frames(spark, f"{root}/flat").collect()] == ["a.jpg"]
    assert files.first_entry(spark, f"{root}/flat").first()["name"] == "a.jpg"
    sat = {os.path.basename(r["path"]): r["image_type"] for r in files.satellite_images(spark, [f"{root}/x", f"{root}/y", f"{root}/missing"]).collect()}
    assert sat == {"1.tif": "pre", "2.TIFF": "post", "3.tif": "pre", "pre_4.tif": "unknown"}
    assert files.drone_images(spark, f"{root}/missing").count() == 0


def test_social_posts(spark, tmp_path):
    path = str(tmp_path / "posts.jsonl")
    touch(path, '{"id":"1","text":"flood é","hazard":"flood","extra":1}\n\n{"id":"2","text":null}\n{"text":""}\n')
    rows = files.social_posts(spark, path).select(*exprs.social_message(F.col("id"), F.col("text"), F.col("hazard"), F.lit(1.5))).collect()
    assert [(r["id"], r["text"], r["hazard"], r["source"]) for r in rows] == [("1", "flood é", "flood", "twitter"), ("2", "", None, "twitter"), (None, "", None, "twitter")]
    value = sinks.to_topic(spark.createDataFrame(rows), "social").collect()
    assert value[0]["topic"] == "social-posts" and json.loads(value[2]["value"]) == {"id": None, "text": "", "hazard": None, "timestamp": 1.5, "source": "twitter"}
    touch(path, '{"id":"1"}\nnot json\n')
    assert files.social_posts(spark, path, strict=False).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.social_posts(spark, path).collect()


COCO = {
    "images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "b.c.jpg", "width": 10, "height": 10}, {"id": 1, "file_name": "a.jpg", "width": 200, "height": 50}],
    "annotations": [{"image_id": 1, "category_id": 1, "damage_bbox": b} for b in ([10, 10, 20, 20], None, [1, 2, 3], [0, 0, 0, 5], [0, 0, 5, -1], [190, 40, 40, 40])],
    "categories": [{"id": 1, "name": "x"}],
}


def test_annotations_to_label_files(spark, tmp_path):
    path = str(tmp_path / "instances.json")
    touch(path, json.dumps(COCO))
    images, notes, cats = files.coco_tables(spark, path)
    assert cats.count() == 1
    lookup = labels.image_lookup(images, "pos")
    assert {r["id"]: r["width"] for r in lookup.collect()} == {1: 200, 2: 10}
    lines = labels.label_lines(labels.to_yolo(notes, lookup, strict=True))
    got = {r["stem"]: r["text"] for r in labels.label_files(lines, lookup).collect()}
    assert got == {"a": "0 0.100000 0.400000 0.100000 0.400000\n0 1.050000 1.200000 0.200000 0.800000\n", "b.c": ""}
    sinks.write_label_files(labels.label_files(lines, lookup), str(tmp_path / "labels"))
    back = files.label_rows(spark, str(tmp_path / "labels"), "train")
    assert sorted((r["stem"], r["xc"], r["split"]) for r in back.collect()) == [("a", 0.1, "train"), ("a", 1.05, "train")]
    orphan = notes.unionByName(spark.createDataFrame([(9, 1, [1.0, 1.0, 1.0, 1.0])], notes.schema))
    assert labels.to_yolo(orphan, lookup).count() == 2
    with pytest.raises(Exception, match="unknown image"):
        labels.to_yolo(orphan, lookup, strict=True).collect()


def test_copy_splits(spark, tmp_path):
    touch(f"{tmp_path}/i/a.jpg", "A")
    touch(f"{tmp_path}/i/b.jpg", "B")
    touch(f"{tmp_path}/l/a.txt", "0")
    rows = spark.createDataFrame([(f"{tmp_path}/i/a.jpg", f"{tmp_path}/l/a.txt", "train"), (f"{tmp_path}/i/b.jpg", f"{tmp_path}/l/b.txt", "val")], "image_path string, label_path string, split string")
    assert sinks.copy_splits(rows, f"{tmp_path}/out").count() == 3
    assert os.path.exists(f"{tmp_path}/out/val/images/b.jpg") and not os.path.exists(f"{tmp_path}/out/val/labels/b.txt")
    gone = spark.createDataFrame([(f"{tmp_path}/i/none.jpg", None, "val")], rows.schema)
    with pytest.raises(Exception, match="none.jpg"):
        sinks.copy_splits(gone, f"{tmp_path}/out").collect()
    with pytest.raises(ValueError, match="a.jpg"):
        sinks.copy_splits(rows.unionByName(spark.createDataFrame([(f"{tmp_path}/j/a.jpg", None, "train")], rows.schema)), f"{tmp_path}/out")


def test_report(spark, tmp_path):
    at = verify.Layout(str(tmp_path))
    rows = {r["check_id"]: r for r in verify.report(spark, at).collect()}
    assert len(rows) == 13 and not any(r["ok"] for r in rows.values())
    touch(at.path("instances"), json.dumps(COCO))
    for f in ("images", "all_images", "train_images", "val_images"):
        touch(f"{at.path(f)}/x.png")
    for f in ("all_labels", "train_labels", "val_labels"):
        touch(f"{at.path(f)}/x.txt")
    touch(at.path("posts"))
    touch(at.path("classes"), "one\n\n two \n")
    touch(at.path("descriptor"), "path: /data\nnames:\n  0: damage_class_1\n  1: damage_class_2\nflag: true # on\nrate: 0.01\n")
    touch(at.path("weights"))
    got = verify.report(spark, at)
    rows = {r["check_id"]: r for r in got.collect()}
    assert rows["V1"]["details"] == "3 images, 6 annotations, 1 categories" and rows["V6"]["details"] == "2 classes"
    assert verify.all_good(got).first()["complete"] and not rows["V13"]["ok"]
    touch(at.path("metrics"), "epoch, metrics/mAP50(B)\n1, 0.25\n2, 0.5\n10, 0.75\n")
    assert verify.last_metric(files.csv_table(spark, at.path("metrics"))).first().asDict() == {"epochs": 3, "metric": "0.75"}
    assert files.settings(spark, at.path("descriptor")) == {"path": "/data", "names": {0: "damage_class_1", 1: "damage_class_2"}, "flag": True, "rate": 0.01}
    assert [r["name"] for r in files.class_list(spark, at.path("classes")).collect()] == ["one", "two"]


def test_detector_runs_in_batches(spark):
    def model():
        return lambda data: [[{"class_id": len(d), "confidence": 0.5, "bbox": [0.0, 0.0, 1.0, float(len(data))]}] if d else None for d in data]

    df = spark.createDataFrame([(f"p{i}", bytearray(b"x" * i)) for i in range(6)], "image_path string, data binary").coalesce(1)
    got = {r["image_path"]: r["detections"] for r in vision.detect(df, model).collect()}
    assert got["p0"] == [] and got["p3"][0]["bbox"][3] == 4.0 and got["p5"][0]["bbox"][3] == 2.0


def test_iou_expression(spark):
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 3.0, 3.0]), ([0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(exprs.iou(F.col("a"), F.col("b"))).collect()] == [1 / 7, 0.0]


def test_stems(spark):
    df = spark.createDataFrame([(x,) for x in ("a.jpg", "a.b.jpg", "plain", ".hidden", "..x.y")], "n string")
    assert [r[0] for r in df.select(exprs.stem(F.col("n"))).collect()] == [os.path.splitext(x)[0] for x in ("a.jpg", "a.b.jpg", "plain", ".hidden", "..x.y")]


def test_printed_report_and_logging(spark, tmp_path, caplog):
    from skywright.functions import log

    lines = [r["line"] for r in verify.printed(verify.report(spark, verify.Layout(str(tmp_path)))).orderBy("line_no").collect()]
    assert len(lines) == 16 and lines[0] == lines[-1] == "=" * 70 and lines[1] == "\u2717 COCO annotations merged" and lines[-2].startswith("\u2717 PIPELINE INCOMPLETE")
    with caplog.at_level("INFO", logger="skywright"):
        log.log_info("a")
        log.log_warning("b")
        log.log_error("c")
    assert [(r.levelname, r.message) for r in caplog.records] == [("INFO", "a"), ("WARNING", "b"), ("ERROR", "c")]


def test_kafka_sink_takes_the_envelope(spark):
    rows = sinks.to_topic(spark.createDataFrame([("1", 2.0)], "id string, timestamp double"), "social")
    assert rows.columns == ["topic", "value"] and rows.first()["value"] == '{"id":"1","timestamp":2.0}'
    with pytest.raises(Exception, match="(?i)kafka"):  # the connector is not on the class path here
        sinks.write_kafka(rows)
