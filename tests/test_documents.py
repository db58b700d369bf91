"""A large document by byte ranges equals Spark's reader of whole documents, wherever the ranges cut."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywright.sources import documents, files


def write(path, doc, **how):
    path.mkdir()
    (path / "part-0.json").write_text(json.dumps(doc, **how))
    return str(path)


NASTY = ['a"b', "back\\slash", '\\"', "\\\\", "{[", "]}", '"images": [', "é😀\u0000", ":", ""]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000, 1 << 20])
def test_every_cut(spark, tmp_path, size):
    rng = random.Random(size)
    images = [{"id": i, "file_name": rng.choice(NASTY) * rng.randint(0, 3), "width": i, "height": 2, "extra": {"annotations": [{"x": rng.choice(NASTY)}]}} for i in range(12 if size < 7 else 40)]
    notes = [{"image_id": i, "category_id": 1, "damage_bbox": [1.5, 2.0, i, 0.25] if i % 3 else None} for i in range(9)]
    doc = {"info": {"images": {"id": 99}}, "note": rng.choice(NASTY), "images": images, "none": [], "annotations": notes, "numbers": [[1, 2], [3]], "categories": [{"id": 1, "name": 'one"'}], "last": "annotations"}
    path = write(tmp_path / "doc", doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
    got, want = documents.annotation_tables(spark, path, size), files.coco_tables(spark, path)
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(got[1]) == key(want[1]) and key(got[2]) == key(want[2]) and key(got[0].drop("pos")) == key(want[0].drop("pos"))
    order = lambda d: [r["id"] for r in d.orderBy("pos").collect()]
    assert order(got[0]) == order(want[0])


def test_missing_lists_and_broken_entries(spark, tmp_path):
    images, notes, kinds = documents.annotation_tables(spark, write(tmp_path / "a", {"images": [{"id": 1}]}))
    assert (images.count(), notes.count(), kinds.count()) == (1, 0, 0)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{"images": [{"id": 1}, {"id": zero}]}')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        documents.annotation_tables(spark, str(tmp_path / "b"))[0].collect()


def test_states_of_a_range():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice('ab"\\{}[]') for _ in range(rng.randint(0, 30)))
        data = np.frombuffer(text.encode(), np.uint8)
        for state in range(3):
            now, depth = state, 0
            for c in text:
                if now == 2:
                    now = 1
                elif now == 1:
                    now = {'"': 0, "\\": 2}.get(c, 1)
                else:
                    now, depth = (1 if c == '"' else 0), depth + (c in "{[") - (c in "}]")
                    if c == "\\":
                        break  # no JSON
            else:
                _, inside, end = documents.lexed(data, state)
                assert (end, int(documents.depths(data, inside).sum())) == (now, depth), (text, state)


def test_written_in_files(spark, tmp_path):
    """The files of a written document are one JSON object, none holds more rows than asked for, and ranges that cut them anywhere give its rows."""
    images = spark.createDataFrame([(i % 70, f"f{i % 70}\"{{", i % 70, 2) for i in range(140)], "id long, file_name string, width int, height int")
    notes = spark.createDataFrame([(7, 1, [1.0, 2.0])] * 30 + [(i, 2, None) for i in range(60)], "image_id long, category_id long, damage_bbox array<double>")
    kinds = spark.createDataFrame([], "name string")
    path = str(tmp_path / "doc")
    documents.write_document({"images": images, "annotations": notes, "categories": kinds}, path, 40)
    texts = [p.read_text() for p in sorted((tmp_path / "doc").glob("*/*.txt"))]
    doc = json.loads("".join(texts))
    assert [len(doc[k]) for k in ("images", "annotations", "categories")] == [140, 90, 0]
    assert len([t for t in texts if t.count("\n") > 1]) > 4
    key = lambda d: sorted(map(repr, d.collect()))
    for size in (97, 5000, 1 << 20):
        got = documents.annotation_tables(spark, path, size, parts=True)
        assert key(got[0].select(*images.columns)) == key(images) and key(got[1].select(*notes.columns)) == key(notes) and got[2].count() == 0
        assert [r["id"] for r in got[0].orderBy("pos").collect()] == [x["id"] for x in doc["images"]]


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    """The rows that stand for ranges are small, and still their bytes are dealt to tasks: no task writes more than its share of the entries."""
    notes = [{"image_id": i, "category_id": 1, "damage_bbox": [1.5, 2.0, i, 0.25]} for i in range(3000)]
    path = write(tmp_path / "doc", {"images": [], "annotations": notes, "categories": []})
    read = documents.annotation_tables(spark, path, 2000)[1]
    files_of = [r["count"] for r in read.groupBy(F.input_file_name().alias("file")).count().collect()]
    assert len(files_of) == 2 * spark.sparkContext.defaultParallelism and sum(files_of) == 3000 and max(files_of) < 2 * 3000 / len(files_of)
    assert sorted(r["image_id"] for r in read.collect()) == list(range(3000))


def test_a_task_reads_so_many_bytes(spark, monkeypatch, tmp_path):
    """The number of tasks grows with the document."""
    monkeypatch.setattr(documents, "TASK_BYTES", 4000)
    notes = [{"image_id": i, "category_id": 1, "damage_bbox": None} for i in range(1500)]
    path = write(tmp_path / "doc", {"annotations": notes})
    read = documents.annotation_tables(spark, path, 1000)[1]
    assert len(read.inputFiles()) == -(-(tmp_path / "doc" / "part-0.json").stat().st_size // 4000) and read.count() == 1500


def test_entries_are_parsed_once(spark, tmp_path):
    """Filters on several columns of an entry bring no copies of the parser."""
    notes = [{"image_id": i, "category_id": 1, "damage_bbox": [1.5, 2.0, i, 0.25]} for i in range(9)]
    read = documents.annotation_tables(spark, write(tmp_path / "doc", {"annotations": notes}))[1].where("image_id > 3 AND category_id = 1 AND damage_bbox[2] > 5")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(r["image_id"] for r in read.collect()) == [6, 7, 8]
