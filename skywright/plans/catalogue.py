"""Registered queries of the reference's operators over the driver's tables, and the same in DuckDB SQL.

Stand-ins: lineitem rows are box annotations of orders (images); events are frames named by their number; embeddings are images whose 64
values stand for pixels; pages and documents are map images and posts. Every query reads its whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywright.functions import exprs
from skywright.operators import evaluate, frames, labels, ordered, vision
from skywright.sources import sinks

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Annotations and images.


def _annotations(spark, d) -> DataFrame:
    box = F.array(F.col("l_extendedprice") / 100, F.col("l_quantity") * 2, F.col("l_discount") * 1000 - 10, F.col("l_tax") * 1000)
    box = F.when(F.col("l_linenumber") == 7, None).when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "R"), F.slice(box, 1, 3)).otherwise(box)
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 3 + 1).alias("category_id"), box.alias("damage_bbox"))


def _images(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("img_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), (F.col("o_orderkey") % 400 + 600).cast("int").alias("width"), (F.col("o_custkey") % 300 + 480).cast("int").alias("height"))


_YOLO = """
WITH a AS (SELECT l_orderkey AS image_id, l_linenumber % 3 + 1 AS category_id, l_extendedprice / 100 AS x, l_quantity * 2 AS y, l_discount * 1000 - 10 AS bw, l_tax * 1000 AS bh
  FROM lineitem WHERE NOT (l_linenumber = 7 OR (l_linenumber = 6 AND l_returnflag = 'R'))),
i AS (SELECT o_orderkey AS id, o_orderkey % 400 + 600 AS width, o_custkey % 300 + 480 AS height FROM orders),
y AS (SELECT image_id, CAST(category_id - 1 AS INTEGER) AS class_id, (x + bw / 2) / width AS xc, (y + bh / 2) / height AS yc, bw / width AS w, bh / height AS h, width, height
  FROM a JOIN i ON a.image_id = i.id WHERE bw > 0 AND bh > 0)
"""


def _yolo(spark, d) -> DataFrame:
    return labels.to_yolo(_annotations(spark, d), _images(spark, d))


@query("coco_to_yolo", _YOLO + "SELECT image_id, class_id, CAST(floor(xc * 1e6) AS BIGINT) AS xc_u, CAST(floor(yc * 1e6) AS BIGINT) AS yc_u, CAST(floor(w * 1e6) AS BIGINT) AS w_u, CAST(floor(h * 1e6) AS BIGINT) AS h_u FROM y")
def coco_to_yolo(spark, d):
    u = lambda c: F.floor(F.col(c) * F.lit(1e6)).cast("bigint").alias(f"{c}_u")
    return _yolo(spark, d).select("image_id", "class_id", u("xc"), u("yc"), u("w"), u("h"))


@query("yolo_lines", _YOLO + "SELECT image_id, printf('%d %.6f %.6f %.6f %.6f', class_id, xc, yc, w, h) AS line FROM y")
def yolo_lines(spark, d):
    return labels.label_lines(_yolo(spark, d)).select("image_id", "line")


@query("yolo_images_left", _YOLO + "SELECT i.id AS image_id, CAST(count(y.image_id) AS BIGINT) AS n_boxes FROM i LEFT JOIN y ON i.id = y.image_id GROUP BY i.id")
def yolo_images_left(spark, d):
    return labels.boxes_per_image(_yolo(spark, d), _images(spark, d))


@query("yolo_label_files", _YOLO + ", f AS (SELECT image_id, string_agg(line || chr(10), '' ORDER BY line) AS text FROM (SELECT image_id, printf('%d %.6f %.6f %.6f %.6f', class_id, xc, yc, w, h) AS line FROM y) GROUP BY image_id) SELECT 'img_' || i.id AS stem, coalesce(text, '') AS text FROM i LEFT JOIN f ON i.id = f.image_id")
def yolo_label_files(spark, d):
    return labels.label_files(labels.label_lines(_yolo(spark, d)), _images(spark, d))


@query("converted_count", _YOLO + "SELECT count(*) AS converted FROM y")
def converted_count(spark, d):
    return _yolo(spark, d).agg(F.count("*").alias("converted"))


@query("yolo_to_pixels", _YOLO + """SELECT image_id, class_id, CAST(trunc(xc * width - w * width / 2) AS INTEGER) AS x1, CAST(trunc(yc * height - h * height / 2) AS INTEGER) AS y1,
  CAST(trunc(xc * width + w * width / 2) AS INTEGER) AS x2, CAST(trunc(yc * height + h * height / 2) AS INTEGER) AS y2 FROM y""")
def yolo_to_pixels(spark, d):
    return _yolo(spark, d).select("image_id", "class_id", *exprs.pixel_corners(*map(F.col, ("xc", "yc", "w", "h", "width", "height"))))


@query("class_hist", _YOLO + "SELECT class_id, count(*) AS n FROM y GROUP BY class_id")
def class_hist(spark, d):
    return labels.class_histogram(_yolo(spark, d), ["class_id"])


@query("coco_sizes", "SELECT (SELECT count(*) FROM orders) AS images, (SELECT count(*) FROM lineitem) AS annotations, (SELECT count(DISTINCT p_type) FROM part) AS categories")
def coco_sizes(spark, d):
    none = F.lit(0).cast("bigint")
    part = lambda t, i, a, c: _t(spark, d, t).agg(i.alias("images"), a.alias("annotations"), c.alias("categories"))
    rows = part("orders", F.count("*"), none, none).unionByName(part("lineitem", none, F.count("*"), none)).unionByName(part("part", none, none, F.count_distinct("p_type")))
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


@query("lookup_last_wins", "SELECT event_id % 100 AS id, arg_max('f_' || event_id || '.jpg', event_id) AS file_name, CAST(arg_max(event_id % 640, event_id) AS INTEGER) AS width, CAST(arg_max(event_id % 480, event_id) AS INTEGER) AS height FROM events GROUP BY ALL")
def lookup_last_wins(spark, d):
    e = F.col("event_id")
    rows = _t(spark, d, "events").select(e.alias("pos"), (e % 100).alias("id"), F.concat(F.lit("f_"), e.cast("string"), F.lit(".jpg")).alias("file_name"), (e % 640).cast("int").alias("width"), (e % 480).cast("int").alias("height"))
    return labels.image_lookup(rows, "pos")


@query("image_label_join", _YOLO + "SELECT 'img_' || image_id || '.jpg' AS file_name, class_id, CAST(floor(xc * 1e6) AS BIGINT) AS xc_u FROM y")
def image_label_join(spark, d):
    rows = _yolo(spark, d).select(exprs.stem(F.col("file_name")).alias("stem"), "class_id", "xc")
    return labels.labelled_images(_images(spark, d).select("file_name"), rows).select("file_name", "class_id", F.floor(F.col("xc") * F.lit(1e6)).cast("bigint").alias("xc_u"))


def _large_document(spark, d):
    """A document of all orders, line items and part types as many tasks write its files, and its tables as many tasks read them."""
    from skywright.sources import documents
    from skywright.sources.storage import run_dir

    path = f"{run_dir(spark)}/document-{uuid.uuid4().hex}"
    kinds = _t(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    documents.write_document({"images": _images(spark, d), "annotations": _annotations(spark, d), "categories": kinds}, path)
    return documents.annotation_tables(spark, path, 512 << 10, parts=True)


@query("large_document", "SELECT l_orderkey AS image_id, l_linenumber % 3 + 1 AS category_id, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN [l_extendedprice / 100, l_quantity * 2, l_discount * 1000 - 10] ELSE [l_extendedprice / 100, l_quantity * 2, l_discount * 1000 - 10, l_tax * 1000] END AS damage_bbox FROM lineitem")
def large_document(spark, d):
    return _large_document(spark, d)[1]


@query("large_document_boxes", _YOLO + "SELECT image_id, class_id, CAST(floor(xc * 1e6) AS BIGINT) AS xc_u, CAST(floor(h * 1e6) AS BIGINT) AS h_u FROM y")
def large_document_boxes(spark, d):
    """Images and annotations of the document, joined and normalised."""
    images, notes, _ = _large_document(spark, d)
    u = lambda c: F.floor(F.col(c) * F.lit(1e6)).cast("bigint").alias(f"{c}_u")
    return labels.to_yolo(notes, labels.image_lookup(images, "pos")).select("image_id", "class_id", u("xc"), u("h"))


# Messages.

_EXT = "CASE event_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.TIF' ELSE '.tiff' END"
_DIR = "CASE event_id % 5 WHEN 0 THEN '/data/Pre_event' WHEN 1 THEN '/data/POST' WHEN 2 THEN '/data/pre_and_post' WHEN 3 THEN '/data/other' ELSE '/data/pos/t' END"
_FILES = f"WITH f AS (SELECT event_id, {_DIR} || '/pre_' || event_id || {_EXT} AS path, 'pre_' || event_id || {_EXT} AS name FROM events) "


def _files(spark, d) -> DataFrame:
    path = F.concat(F.expr(_DIR), F.lit("/pre_"), F.col("event_id").cast("string"), F.expr(_EXT))
    return _t(spark, d, "events").select("event_id", path.alias("path"), exprs.base_name(path).alias("name"))


def _now():
    return F.lit(0.0)  # the sending time is left out of what is compared

_DRONE = "SELECT name AS frame_id, path AS image_path, 'drone' AS source FROM f WHERE lower(name) LIKE '%.jpg'"
_GIS = "SELECT name AS map_id, path AS image_path, 'gis' AS source FROM f WHERE regexp_matches(lower(name), '[.](jpg|jpeg|png)$')"
_TYPE = "CASE WHEN lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) LIKE '%pre%' THEN 'pre' WHEN lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) LIKE '%post%' THEN 'post' ELSE 'unknown' END"
_SAT = f"SELECT name AS image_id, path AS image_path, {_TYPE} AS image_type, 'satellite' AS source FROM f WHERE regexp_matches(lower(name), '[.]tiff?$')"
_SOCIAL = "SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END, '') AS text, source AS hazard, 'twitter' AS source FROM documents"


def _drone(spark, d):
    return _files(spark, d).where(exprs.is_drone_image(F.col("name"))).select(*exprs.drone_message(F.col("path"), _now()))


def _gis(spark, d):
    return _files(spark, d).where(exprs.is_gis_image(F.col("name"))).select(*exprs.gis_message(F.col("path"), _now()))


def _satellite(spark, d):
    return _files(spark, d).where(exprs.is_satellite_image(F.col("name"))).select(*exprs.satellite_message(F.col("path"), _now()))


def _social(spark, d):
    text = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    return _t(spark, d, "documents").select(*exprs.social_message(F.col("doc_id"), text, F.col("source"), _now()))


@query("msg_drone", _FILES + _DRONE)
def msg_drone(spark, d):
    return _drone(spark, d).drop("timestamp")


@query("msg_gis", _FILES + _GIS)
def msg_gis(spark, d):
    return _gis(spark, d).drop("timestamp")


@query("msg_satellite", _FILES + _SAT)
def msg_satellite(spark, d):
    return _satellite(spark, d).drop("timestamp")


@query("msg_social", _SOCIAL)
def msg_social(spark, d):
    return _social(spark, d).drop("timestamp")


@query("union_topics", f"{_FILES} SELECT topic, count(*) AS n, count(DISTINCT k) AS n_keys FROM (SELECT 'drone-video' AS topic, frame_id AS k FROM ({_DRONE}) UNION ALL SELECT 'gis-data', map_id FROM ({_GIS}) UNION ALL SELECT 'satellite-imagery', image_id FROM ({_SAT}) UNION ALL SELECT 'social-posts', id FROM ({_SOCIAL})) GROUP BY topic")
def union_topics(spark, d):
    key = {"drone": "$.frame_id", "gis": "$.map_id", "satellite": "$.image_id", "social": "$.id"}
    parts = [sinks.to_topic(f(spark, d), k).withColumn("k", F.get_json_object("value", key[k])) for k, f in (("drone", _drone), ("gis", _gis), ("satellite", _satellite), ("social", _social))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_keys"))


@query("wire_nulls", "SELECT doc_id, '{\"id\":\"' || doc_id || '\",\"hazard\":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '\"' || source || '\"' END || '}' AS value FROM documents")
def wire_nulls(spark, d):
    return _t(spark, d, "documents").select("doc_id", exprs.wire(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("hazard")).alias("value"))


def _extension_query(name: str, keep, sql: str) -> None:
    @query(name, f"{_FILES} SELECT event_id, name FROM f WHERE {sql}")
    def run(spark, d):
        return _files(spark, d).where(keep(F.col("name"))).select("event_id", "name")


_extension_query("ext_filter_drone", exprs.is_drone_image, "lower(name) LIKE '%.jpg'")
_extension_query("ext_filter_gis", exprs.is_gis_image, "regexp_matches(lower(name), '[.](jpg|jpeg|png)$')")
_extension_query("ext_filter_satellite", exprs.is_satellite_image, "regexp_matches(lower(name), '[.]tiff?$')")
_extension_query("ext_filter_strict", exprs.is_frame_strict, "name LIKE '%.jpg'")


@query("sorted_frames", f"{_FILES} SELECT name, row_number() OVER (ORDER BY name) AS place FROM f WHERE name LIKE '%.jpg'")
def sorted_frames(spark, d):
    f = _files(spark, d).where(exprs.is_frame_strict(F.col("name"))).select("name")
    return ordered.numbered(f, [], ["name"], "place", pieces=32)


@query("prepost_label", f"{_FILES} SELECT event_id, {_TYPE} AS image_type FROM f")
def prepost_label(spark, d):
    return _files(spark, d).select("event_id", exprs.image_type(F.col("path")).alias("image_type"))


@query("jsonl_project", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsonl_project(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("stems", f"{_FILES} SELECT event_id, regexp_replace(name, '[.][^.]*$', '') AS stem, regexp_replace(name, '[.][^.]*$', '') || '.txt' AS label FROM f")
def stems(spark, d):
    return _files(spark, d).select("event_id", exprs.stem(F.col("name")).alias("stem"), exprs.label_file(F.col("name")).alias("label"))


# Ordered operators over embeddings: 64 values as pixels, streams by label, order by vec_id.

_BITS = "[CASE WHEN v > 0 THEN 1 ELSE 0 END FOR v IN embedding]"


def _frames(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings")
    q = F.transform("embedding", lambda v: F.floor(v.cast("double") * 255).cast("int"))
    e = e.select("vec_id", "label", exprs.sign_hash(F.col("embedding")).alias("hash"), q.alias("pixels"), F.array_max("embedding").cast("double").alias("peak"))
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, x: a + x)
    squares = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x)
    return e.withColumn("var_num", F.size("pixels") * squares - total * total)


def _dedup_sql(bits: int) -> str:
    return f"""
b AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, {_BITS} AS h FROM embeddings),
r AS (SELECT label, vec_id, rn, FALSE AS dup, [h] AS win FROM b WHERE rn = 1
  UNION ALL SELECT label, vec_id, rn, dup, CASE WHEN dup THEN win ELSE list_slice(list_append(win, h), greatest(1, len(win) + 2 - 20), len(win) + 1) END
  FROM (SELECT b.label, b.vec_id, b.rn, b.h, r.win, coalesce(list_bool_or([list_sum([CASE WHEN x[i] <> b.h[i] THEN 1 ELSE 0 END FOR i IN range(1, 65)]) <= {bits} FOR x IN r.win]), FALSE) AS dup FROM r JOIN b ON b.label = r.label AND b.rn = r.rn + 1))
"""


def _dedup(spark, d, bits):
    return ordered.dedup_window(_frames(spark, d).select("label", "vec_id", "hash"), ["label"], ["vec_id"], bits=bits)


@query("dedup_window20", "WITH RECURSIVE " + _dedup_sql(5) + "SELECT label, vec_id, dup AS is_duplicate FROM r")
def dedup_window20(spark, d):
    return _dedup(spark, d, 5).select("label", "vec_id", "is_duplicate")


@query("dedup_window20_loose", "WITH RECURSIVE " + _dedup_sql(22) + "SELECT label, vec_id, dup AS is_duplicate FROM r")
def dedup_window20_loose(spark, d):
    return _dedup(spark, d, 22).select("label", "vec_id", "is_duplicate")


_Q = "[CAST(floor(CAST(v AS DOUBLE) * 255) AS BIGINT) FOR v IN embedding]"
_CHANGED = "list_sum([CASE WHEN abs(p[i] - q[i]) > 25 THEN 1 ELSE 0 END FOR i IN range(1, 65)])"


@query("motion_lag", f"""WITH q AS (SELECT label, vec_id, {_Q} AS q, lag({_Q}) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT label, vec_id, CAST(CASE WHEN p IS NULL THEN 100 ELSE {_CHANGED} END AS BIGINT) AS motion_score, p IS NULL OR {_CHANGED} > 34 AS has_motion FROM q""")
def motion_lag(spark, d):
    f = _frames(spark, d).select("label", "vec_id", "pixels")
    return ordered.with_motion(f, ["label"], ["vec_id"], "pixels", least=34).select("label", "vec_id", "motion_score", "has_motion")


@query("blur_variance", f"SELECT vec_id, CAST(64 * list_sum([v * v FOR v IN q]) - list_sum(q) * list_sum(q) AS BIGINT) AS var_num, (64 * list_sum([v * v FOR v IN q]) - list_sum(q) * list_sum(q)) / 4096.0 < 1000 AS blurry FROM (SELECT vec_id, {_Q} AS q FROM embeddings)")
def blur_variance(spark, d):
    return _frames(spark, d).select("vec_id", "var_num", frames.is_blurry(F.col("var_num") / 4096, 1000).alias("blurry"))


@query("valid_size", "SELECT doc_id, n_chars >= 100 AS valid FROM documents")
def valid_size(spark, d):
    return _t(spark, d, "documents").select("doc_id", frames.valid_size(F.col("n_chars"), F.col("n_chars")).alias("valid"))


# Pictures of 8 x 8 pixels: byte i of the embedding is blue there, the bytes 21 and 42 places on are green and red.

_AXIS = "SELECT i, greatest(0, least(7, CAST(floor(z) AS BIGINT))) AS lo, least(7, greatest(0, least(7, CAST(floor(z) AS BIGINT))) + 1) AS hi, CASE WHEN floor(z) < 0 OR floor(z) >= 7 THEN 0 ELSE CAST(round_even((z - floor(z)) * 2048, 0) AS BIGINT) END AS f FROM (SELECT i, (i + 0.5::DOUBLE) * (8 / 5::DOUBLE) - 0.5::DOUBLE AS z FROM (SELECT unnest(range(5)) AS i))"
_SINC = """SELECT i, list(CAST(trunc(w / s * 4194304 + CASE WHEN w < 0 THEN -0.5 ELSE 0.5 END) AS BIGINT) ORDER BY x) AS k FROM (SELECT *, sum(w) OVER (PARTITION BY i) AS s FROM (
  SELECT i, x, CASE WHEN x < greatest(0, CAST(trunc(c - r + 0.5) AS BIGINT)) OR x >= least(8, CAST(trunc(c + r + 0.5) AS BIGINT)) OR z < -3 OR z >= 3 THEN 0 WHEN z = 0 THEN 1.0::DOUBLE ELSE sin(pi() * z) / (pi() * z) * sin(pi() * (z / 3)) / (pi() * (z / 3)) END AS w
  FROM (SELECT i, x, c, 3 * 1.6::DOUBLE AS r, (x - c + 0.5::DOUBLE) / 1.6::DOUBLE AS z FROM (SELECT i, x, (i + 0.5::DOUBLE) * 1.6::DOUBLE AS c FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(8)) AS x))))) GROUP BY i"""


@query("picture_numbers", f"""WITH b AS (SELECT vec_id, [greatest(0, least(255, v + 128)) FOR v IN {_Q}] AS v FROM embeddings),
g AS (SELECT vec_id, [(3735 * v[i] + 19235 * v[(i + 20) % 64 + 1] + 9798 * v[(i + 41) % 64 + 1] + 16384) >> 15 FOR i IN range(1, 65)] AS g, [(7471 * v[i] + 38470 * v[(i + 20) % 64 + 1] + 19595 * v[(i + 41) % 64 + 1] + 32768) >> 16 FOR i IN range(1, 65)] AS h FROM b),
n AS (SELECT unnest(range(64)) AS p), w AS (SELECT p, p // 8 AS y, p % 8 AS x FROM n),
l AS (SELECT vec_id, g[CASE WHEN y = 0 THEN 1 ELSE y - 1 END * 8 + x + 1] + g[CASE WHEN y = 7 THEN 6 ELSE y + 1 END * 8 + x + 1] + g[y * 8 + CASE WHEN x = 0 THEN 1 ELSE x - 1 END + 1] + g[y * 8 + CASE WHEN x = 7 THEN 6 ELSE x + 1 END + 1] - 4 * g[p + 1] AS l FROM g, w),
v AS (SELECT vec_id, CAST(64 * sum(l * l) - sum(l) * sum(l) AS BIGINT) AS laplacian FROM l GROUP BY vec_id),
a AS ({_AXIS}), k AS ({_SINC}),
s AS (SELECT vec_id, list((((2048 - y.f) * ((g[y.lo * 8 + x.lo + 1] * (2048 - x.f) + g[y.lo * 8 + x.hi + 1] * x.f) >> 4)) >> 16) + ((y.f * ((g[y.hi * 8 + x.lo + 1] * (2048 - x.f) + g[y.hi * 8 + x.hi + 1] * x.f) >> 4)) >> 16) + 2 >> 2 ORDER BY y.i, x.i) AS small FROM g, a y, a x GROUP BY vec_id),
r AS (SELECT vec_id, y, k.i, greatest(0, least(255, (list_sum([h[y * 8 + x + 1] * k.k[x + 1] FOR x IN range(8)]) + 2097152)::BIGINT >> 22)) AS p FROM g, k, (SELECT unnest(range(8)) AS y)),
c AS (SELECT vec_id, i, list(p ORDER BY y) AS p FROM r GROUP BY vec_id, i),
t AS (SELECT vec_id, list(greatest(0, least(255, (list_sum([c.p[y + 1] * k.k[y + 1] FOR y IN range(8)]) + 2097152)::BIGINT >> 22)) ORDER BY k.i, c.i) AS thumb FROM c, k GROUP BY vec_id)
SELECT vec_id, CAST(g AS INTEGER[]) AS gray, laplacian, CAST(small AS INTEGER[]) AS small, CAST(thumb AS INTEGER[]) AS thumb FROM g JOIN v USING (vec_id) JOIN s USING (vec_id) JOIN t USING (vec_id)""")
def picture_numbers(spark, d):
    from skywright.functions import images

    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    q = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 255).cast("int") + 128)))
    e = _t(spark, d, "embeddings").select("vec_id", q.alias("v"))
    pixel = F.transform("v", lambda v, i: F.concat(byte(v), byte(F.get("v", (i + 21) % 64)), byte(F.get("v", (i + 42) % 64))))
    return images.picture_numbers(e.select("vec_id", F.unhex(F.array_join(pixel, "")).alias("data")), "vec_id", "data", 8, 8, 3, 5).drop("phash")


# Batches.

_RN = "(SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)"


@query("batch4", f"SELECT event_type, CAST((rn - 1) // 4 AS BIGINT) AS batch_id, list(event_id ORDER BY rn) AS members FROM {_RN} GROUP BY ALL HAVING count(*) = 4")
def batch4(spark, d):
    return ordered.batches(_t(spark, d, "events"), ["event_type"], ["event_id"], {"members": "event_id"}, pieces=16).select("event_type", "batch_id", "members")


@query("batch4_status", f"SELECT event_id, CAST((rn - 1) // 4 AS BIGINT) AS batch_id, CASE WHEN rn % 4 = 0 THEN 'batch_ready' ELSE 'waiting_for_batch' END AS status FROM {_RN}")
def batch4_status(spark, d):
    return ordered.numbered_batches(_t(spark, d, "events"), ["event_type"], ["event_id"], pieces=16).select("event_id", "batch_id", ordered.batch_status().alias("status"))


@query("batch4_flush", "SELECT conv_id, CAST((rn - 1) // 4 AS BIGINT) AS batch_id, count(*) AS n, list(turn ORDER BY rn) AS turns, list(role ORDER BY rn) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) GROUP BY ALL")
def batch4_flush(spark, d):
    return ordered.batches(_t(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], {"turns": "turn", "roles": "role"}, keep_partial=True)


@query("sampler_interval", """WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_type, event_id, rn, us AS last, TRUE AS accepted FROM e WHERE rn = 1
  UNION ALL SELECT e.event_type, e.event_id, e.rn, CASE WHEN e.us - r.last >= 3600000000 THEN e.us ELSE r.last END, e.us - r.last >= 3600000000 FROM r JOIN e ON e.event_type = r.event_type AND e.rn = r.rn + 1)
SELECT event_type, event_id, accepted FROM r""")
def sampler_interval(spark, d):
    e = _t(spark, d, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ordered.sample_interval(e, ["event_type"], ["us", "event_id"], "us", 3_600_000_000).select("event_type", "event_id", "accepted")


@query("sampler_pieces", ORACLES["sampler_interval"])
def sampler_pieces(spark, d):
    """The same with every stream in pieces."""
    e = _t(spark, d, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ordered.sample_interval(e, ["event_type"], ["us", "event_id"], "us", 3_600_000_000, piece_rows=1000).select("event_type", "event_id", "accepted")


@query("dedup_pieces", ORACLES["dedup_window20_loose"])
def dedup_pieces(spark, d):
    f = _frames(spark, d).select("label", "vec_id", "hash")
    return ordered.dedup_window(f, ["label"], ["vec_id"], bits=22, piece_rows=25).select("label", "vec_id", "is_duplicate")


# Splits.

_SPLIT = """WITH n AS (SELECT doc_id, 'doc_' || doc_id || '.jpg' AS name FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || name), name) AS rk, count(*) OVER () AS n FROM n),
s AS (SELECT doc_id, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r) """


def _split(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("name"))
    return ordered.exact_split(docs, "name").select("doc_id", "split")


def _split_labels(spark, d) -> DataFrame:
    return labels.matched_labels(_split(spark, d), _t(spark, d, "labels"), "doc_id")


@query("split_70_20_10", _SPLIT + "SELECT doc_id, split FROM s")
def split_70_20_10(spark, d):
    return _split(spark, d)


@query("split_sizes", _SPLIT + "SELECT split, count(*) AS n FROM s GROUP BY split")
def split_sizes(spark, d):
    return _split(spark, d).groupBy("split").agg(F.count("*").alias("n"))


@query("split_label_join", _SPLIT + "SELECT s.doc_id, split, l.doc_id IS NOT NULL AS has_label FROM s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def split_label_join(spark, d):
    return _split_labels(spark, d).select("doc_id", "split", "has_label")


@query("split_semi", _SPLIT + "SELECT doc_id, split FROM s WHERE doc_id IN (SELECT doc_id FROM labels)")
def split_semi(spark, d):
    return _split(spark, d).join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("split_anti", _SPLIT + "SELECT doc_id, split FROM s WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def split_anti(spark, d):
    return _split(spark, d).join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


# The whole frame pipeline.

_CHAIN = (
    "WITH RECURSIVE "
    + _dedup_sql(20)
    + f""", f AS (SELECT label, vec_id, {_Q} AS q, list_max(embedding)::DOUBLE >= 0.28::DOUBLE AS ok FROM embeddings),
alive AS (SELECT f.label, f.vec_id, q, lag(q) OVER (PARTITION BY f.label ORDER BY f.vec_id) AS p FROM f JOIN r USING (vec_id) WHERE NOT dup AND ok),
m AS (SELECT label, vec_id, CASE WHEN p IS NULL THEN 100 ELSE {_CHANGED} END AS score, p IS NULL OR {_CHANGED} > 34 AS moves, (64 * list_sum([v * v FOR v IN q]) - list_sum(q) * list_sum(q)) / 4096.0 < 1000 AS blurry FROM alive),
g AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM m WHERE moves AND NOT blurry),
o AS (SELECT f.label, f.vec_id, dup, ok, score, moves, blurry, g.rn AS rn FROM f JOIN r USING (vec_id) LEFT JOIN m USING (vec_id) LEFT JOIN g USING (vec_id)),
"""
)
_FIRST = "WHEN dup THEN 'duplicate' WHEN NOT ok THEN 'invalid_image' WHEN NOT moves THEN 'no_motion'"
_INTENDED = _CHAIN + f"""z AS (SELECT label, vec_id, CASE WHEN rn IS NULL THEN 'skipped' WHEN rn % 4 = 0 THEN 'batch_ready' ELSE 'waiting_for_batch' END AS status,
  CASE {_FIRST} WHEN blurry THEN 'blurry' END AS reason, CAST(CASE WHEN moves = FALSE THEN score END AS BIGINT) AS motion_score, CAST((rn - 1) // 4 AS BIGINT) AS batch_id FROM o) """
_STRICT = _CHAIN + f"z AS (SELECT label, vec_id, 'skipped' AS status, CASE {_FIRST} ELSE 'duplicate' END AS reason, CAST(CASE WHEN moves = FALSE THEN score END AS BIGINT) AS motion_score FROM o) "


def _pipeline(spark, d, mode, **more) -> DataFrame:
    return frames.run_pipeline(_frames(spark, d), ["label"], ["vec_id"], "vec_id", mode, valid=F.col("peak") >= 0.28, variance=F.col("var_num") / 4096, bits=20, least_motion=34, sharpness=1000, **more)


@query("pipeline_intended", _INTENDED + "SELECT * FROM z")
def pipeline_intended(spark, d):
    return _pipeline(spark, d, "intended")


@query("pipeline_pieces", _INTENDED + "SELECT * FROM z")
def pipeline_pieces(spark, d):
    return _pipeline(spark, d, "intended", piece_rows=25, pieces=4)


@query("pipeline_strict", _STRICT + "SELECT * FROM z")
def pipeline_strict(spark, d):
    return _pipeline(spark, d, "strict").drop("batch_id")


@query("envelope_completed", _INTENDED + "SELECT label, vec_id, 'completed' AS status, batch_id FROM z WHERE status = 'batch_ready'")
def envelope_completed(spark, d):
    return vision.envelope(_pipeline(spark, d, "intended")).where(F.col("status") == "completed").select("label", "vec_id", "status", "batch_id")


@query("frame_metadata", f"{_FILES} SELECT path AS image_path, 'drone' AS source, [CAST(event_id % 700 AS INTEGER), CAST(event_id % 900 AS INTEGER), 3] AS original_size, [640, 640, 3] AS processed_size, 19 AS stamp_chars FROM f")
def frame_metadata(spark, d):
    e = F.col("event_id")
    m = _files(spark, d).select(frames.metadata(F.col("path"), (e % 700).cast("int"), (e % 900).cast("int"), F.lit(3)).alias("m")).select("m.*")
    return m.withColumn("stamp_chars", F.length("processed_at")).drop("processed_at")  # the time of processing is left out of what is compared


@query("reason_report", _INTENDED + "SELECT coalesce(reason, status) AS outcome, count(*) AS n FROM z GROUP BY 1")
def reason_report(spark, d):
    return frames.reason_report(_pipeline(spark, d, "intended"))


@query("reduction_pct", _INTENDED + "SELECT count(*) AS total, count(*) FILTER (status <> 'skipped') AS processed, CAST(floor((1 - CAST(count(*) FILTER (status <> 'skipped') AS DOUBLE) / count(*)) * 10000) AS BIGINT) AS reduction_bp FROM z")
def reduction_pct(spark, d):
    return frames.reduction(_pipeline(spark, d, "intended"))


# Detections: boxes from lineitem, by image l_orderkey.

_BOXES = """WITH b AS (SELECT l_orderkey AS image, l_partkey, l_suppkey, l_linenumber, l_linenumber % 3 AS class_id, l_extendedprice AS confidence,
  l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 40.0::DOUBLE AS x2, l_discount * 100 + 30.0::DOUBLE AS y2 FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, l_partkey, l_suppkey, l_linenumber, x1, y1) AS rank FROM b) """


def _boxes(spark, d) -> DataFrame:
    q, y = F.col("l_quantity"), F.col("l_discount") * 100
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("class_id"), F.col("l_extendedprice").alias("confidence"), q.alias("x1"), y.alias("y1"), F.array(q, y, q + 40.0, y + 30.0).alias("bbox"))


_TIE = ["l_partkey", "l_suppkey", "l_linenumber", "x1", "y1"]


@query("topk_maxdet", _BOXES + "SELECT image, l_partkey, l_suppkey, l_linenumber, CAST(rank AS BIGINT) AS rank FROM n WHERE rank <= 3")
def topk_maxdet(spark, d):
    return labels.top_detections(_boxes(spark, d), "image", "confidence", _TIE, 3).select("image", "l_partkey", "l_suppkey", "l_linenumber", "rank")


@query("detections_nested", _BOXES + "SELECT image, list(CAST(class_id AS INTEGER) ORDER BY rank) AS classes, list(confidence ORDER BY rank) AS confidences, count(*) AS n FROM n GROUP BY image")
def detections_nested(spark, d):
    b = _boxes(spark, d).withColumn("down", -F.col("confidence"))
    nested = vision.nested_detections(b, "image", ["down", *_TIE])
    return nested.select("image", F.transform("detections", lambda x: x["class_id"]).alias("classes"), F.transform("detections", lambda x: x["confidence"]).alias("confidences"), F.size("detections").cast("bigint").alias("n"))


@query("zip_meta", "WITH c AS (SELECT conv_id, list(turn ORDER BY turn, role, text) AS a, list(role ORDER BY turn, role, text) AS r FROM conversations GROUP BY conv_id), z AS (SELECT conv_id, a, r[2:] AS r FROM c), i AS (SELECT conv_id, a, r, unnest(range(1, least(len(a), len(r)) + 1)) AS i FROM z) SELECT conv_id, a[i] AS detections, r[i] AS metadata FROM i")
def zip_meta(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    c = c.select("conv_id", F.transform("m", lambda x: x["turn"]).alias("a"), F.slice(F.transform("m", lambda x: x["role"]), 2, F.size("m")).alias("r"))
    return vision.with_metadata(c, "a", "r").select("conv_id", "detections", "metadata")


_AREA = "(x2 - x1) * (y2 - y1)"


@query("nms_iou", "WITH RECURSIVE " + _BOXES.removeprefix("WITH ") + """,
r AS (SELECT image, rank, l_partkey, l_suppkey, l_linenumber, TRUE AS kept, [{'c': class_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS k FROM n WHERE rank = 1
  UNION ALL SELECT image, rank, l_partkey, l_suppkey, l_linenumber, kept, CASE WHEN kept THEN list_append(k, me) ELSE k END FROM (
    SELECT n.image, n.rank, n.l_partkey, n.l_suppkey, n.l_linenumber, r.k, {'c': n.class_id, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2} AS me,
      NOT coalesce(list_bool_or([z.c = n.class_id AND
        greatest(least(z.x2, n.x2) - greatest(z.x1, n.x1), 0) * greatest(least(z.y2, n.y2) - greatest(z.y1, n.y1), 0)
        / ((z.x2 - z.x1) * (z.y2 - z.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) - greatest(least(z.x2, n.x2) - greatest(z.x1, n.x1), 0) * greatest(least(z.y2, n.y2) - greatest(z.y1, n.y1), 0)) > 0.7::DOUBLE FOR z IN r.k]), FALSE) AS kept
    FROM r JOIN n ON n.image = r.image AND n.rank = r.rank + 1))
SELECT image, l_partkey, l_suppkey, l_linenumber, kept FROM r""")
def nms_iou(spark, d):
    b = _boxes(spark, d).withColumn("down", -F.col("confidence"))
    return vision.suppress(b, "image", ["down", *_TIE]).select("image", "l_partkey", "l_suppkey", "l_linenumber", "kept")


# Evaluation: detections are the boxes that were not returned ("A"), ground truth those of lines 1 to 4, moved by the tax.

_IOU = "greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0)"
_AP = f"""WITH d AS (SELECT l_orderkey AS image, l_linenumber % 3 AS class_id, (-l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount * 100) AS o,
  l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 40.0::DOUBLE AS x2, l_discount * 100 + 30.0::DOUBLE AS y2 FROM lineitem WHERE l_returnflag <> 'A'),
g AS (SELECT l_orderkey AS image, l_linenumber % 3 AS class_id, l_quantity + l_tax * 50 AS x1, l_discount * 100 + l_tax * 150 AS y1, l_quantity + l_tax * 50 + 40.0::DOUBLE AS x2, l_discount * 100 + l_tax * 150 + 30.0::DOUBLE AS y2 FROM lineitem WHERE l_linenumber <= 4),
n AS (SELECT class_id, count(*) AS n, (SELECT count(*) FROM d WHERE d.class_id = g.class_id) AS size FROM g GROUP BY class_id),
x AS (SELECT d.image, d.class_id, d.o, coalesce({_IOU} / ((d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - {_IOU}), 0) AS iou, [g.x1, g.y1, g.x2, g.y2] AS box FROM d LEFT JOIN g ON d.image = g.image AND d.class_id = g.class_id),
b AS (SELECT image, class_id, o, max(iou) AS iou, arg_min(box, (-iou, box)) AS box FROM x GROUP BY image, class_id, o),
e AS (SELECT *, coalesce(max(iou) OVER (PARTITION BY image, class_id, box ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
t AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS t),
r AS (SELECT class_id, t, row_number() OVER w AS i, sum(CASE WHEN before < t AND iou >= t THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM e, t WINDOW w AS (PARTITION BY class_id, t ORDER BY o)),
q AS (SELECT class_id, t, i, c, c / n AS recall, c / i AS p FROM r JOIN n USING (class_id) UNION ALL SELECT class_id, t, 0, 0, 0, 1 FROM n, t UNION ALL SELECT class_id, t, size + 1, n, 1, 0 FROM n, t),
v AS (SELECT *, max(p) OVER (PARTITION BY class_id, t ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM q),
l AS (SELECT *, lead(recall) OVER w AS recall2, lead(env) OVER w AS env2 FROM v WINDOW w AS (PARTITION BY class_id, t ORDER BY i)),
z AS (SELECT class_id, t, c, arg_max(recall, i) AS recall, arg_max(env, i) AS env, arg_max(coalesce(recall2, 2), i) AS recall2, arg_max(coalesce(env2, 0), i) AS env2 FROM l GROUP BY class_id, t, c),
s AS (SELECT class_id, t, n, i AS g, i * n AS reach FROM n, t, (SELECT unnest(range(101)) AS i)),
y AS (SELECT s.class_id, s.t, g, env + (g / 100 - recall) * (env2 - env) / (recall2 - recall) AS y FROM s ASOF JOIN (SELECT *, c * 100 AS reach FROM z) z ON s.class_id = z.class_id AND s.t = z.t AND s.reach >= z.reach),
a AS (SELECT class_id, t, sum(CASE WHEN g IN (0, 100) THEN y / 2 ELSE y END) / 100 AS ap FROM y GROUP BY class_id, t) """


def _precisions(spark, d) -> DataFrame:
    found = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("class_id"), (-F.col("l_extendedprice")).alias("down"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), "l_returnflag").where("l_returnflag <> 'A'")
    found = found.withColumn("bbox", F.array("x1", "y1", F.col("x1") + 40.0, F.col("y1") + 30.0)).drop("l_returnflag")
    x, y = F.col("l_quantity") + F.col("l_tax") * 50, F.col("l_discount") * 100 + F.col("l_tax") * 150
    truth = _t(spark, d, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") % 3).alias("class_id"), F.array(x, y, x + 40.0, y + 30.0).alias("bbox"))
    return evaluate.average_precision(found, truth, "image", ["down", "image", *_TIE])


def _micro(c):
    return F.round(F.col(c) * 1e6).cast("bigint").alias(c)


@query("ap_by_class", _AP + "SELECT a.class_id, a.t AS threshold, n.n AS n_truth, size AS n_detections, CAST(m AS BIGINT) AS n_found, CAST(round(ap * 1e6) AS BIGINT) AS ap FROM a JOIN n USING (class_id) JOIN (SELECT class_id, t, max(c) AS m FROM r GROUP BY class_id, t) USING (class_id, t)")
def ap_by_class(spark, d):
    return _precisions(spark, d).select("class_id", "threshold", "n_truth", "n_detections", "n_found", _micro("ap"))


@query("map50", _AP + "SELECT count(*) AS n_classes, CAST(round(avg(ap) * 1e6) AS BIGINT) AS map50 FROM a WHERE t = 0.5")
def map50(spark, d):
    return evaluate.mean_precision(_precisions(spark, d)).select("n_classes", _micro("map50"))


@query("map50_95", _AP + "SELECT CAST(round(avg(ap) * 1e6) AS BIGINT) AS map50_95 FROM (SELECT avg(ap) AS ap FROM a GROUP BY class_id)")
def map50_95(spark, d):
    return evaluate.mean_precision(_precisions(spark, d)).select(_micro("map50_95"))


# Reports.


@query("metric_last", "SELECT count(*) AS n, arg_max(value, event_id) AS last_value FROM events")
def metric_last(spark, d):
    return ordered.last_row(_t(spark, d, "events"), "value", "event_id")


# Streams: run to their end over the events file, with the batch twin's SQL where it has one.


def _event_stream(spark, d) -> DataFrame:
    """The stream source takes folders or patterns; a pattern fits a table of one file and of many."""
    from skywright.streaming import frames as live

    schema = _t(spark, d, "events").schema
    return live.replay(spark, schema, f"{d}/events.parque[t]")


#: Rows that a replayed table admits at once at most.
MOST_ROWS = 1 << 20


def _replayed(rows: DataFrame, order: list[str], most: int = MOST_ROWS) -> DataFrame:
    """A table as a stream in its order, in three steps or more. Stages whose outcome hangs on the order can't read a table's own files as a
    stream: these come by their time of change, and files need not hold, nor be named by, the order of the rows."""
    from skywright.sources.storage import run_dir
    from skywright.streaming import replay

    path = f"{run_dir(rows.sparkSession)}/replay-{uuid.uuid4().hex}"
    replay.ordered_files(rows, order, path)
    return replay.replay_rows(rows.sparkSession, rows.schema, path, pause=1, rows=max(1, min(-(-rows.count() // 3), most)), clock="steps")


@query("stream_sampler", ORACLES["sampler_interval"])
def stream_sampler(spark, d):
    from skywright.streaming import frames as live

    e = _t(spark, d, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    s = live.sample(_replayed(e, ["us", "event_id"]), "event_type", ["us", "event_id"], "us", 3_600_000_000.0)
    return live.run_to_end(s).select("event_type", "event_id", "accepted")


@query("stream_batch4", ORACLES["batch4"])
def stream_batch4(spark, d):
    from skywright.streaming import frames as live

    e = _t(spark, d, "events").select("event_type", "event_id")
    return live.run_to_end(live.batches(_replayed(e, ["event_id"]), "event_type", "event_id", "event_id"))


@query("stream_dedup", ORACLES["dedup_window20_loose"])
def stream_dedup(spark, d):
    from skywright.streaming import frames as live

    e = _replayed(_t(spark, d, "embeddings"), ["vec_id"], MOST_ROWS // 8).select("label", "vec_id", exprs.sign_hash(F.col("embedding")).alias("hash"))
    return live.run_to_end(live.dedup(e, "label", "vec_id", bits=22))


@query("stream_messages", _FILES + _DRONE)
def stream_messages(spark, d):
    from skywright.streaming import frames as live

    path = F.concat(F.expr(_DIR), F.lit("/pre_"), F.col("event_id").cast("string"), F.expr(_EXT))
    s = _event_stream(spark, d).select(path.alias("path")).where(exprs.is_drone_image(exprs.base_name(F.col("path"))))
    return live.run_to_end(live.message_stream(s, "drone").drop("timestamp"))


_BYTES = "[greatest(0, least(255, v + 128)) FOR v IN " + _Q + "]"


@query("stream_motion", f"""WITH q AS (SELECT label, vec_id, {_BYTES} AS q, lag({_BYTES}) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT label, vec_id, CAST(CASE WHEN p IS NULL THEN 100 ELSE {_CHANGED} END AS BIGINT) AS motion_score, p IS NULL OR {_CHANGED} > 34 AS has_motion FROM q""")
def stream_motion(spark, d):
    from skywright.streaming import frames as live

    byte = lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 255).cast("int") + 128))), 2, "0")
    e = _replayed(_t(spark, d, "embeddings"), ["vec_id"], MOST_ROWS // 8).select("label", "vec_id", F.unhex(F.array_join(F.transform("embedding", byte), "")).alias("gray320"))
    return live.run_to_end(live.motion(e, "label", "vec_id", least=34))


@query("stream_flush", ORACLES["batch4_flush"])
def stream_flush(spark, d):
    """Conversations as a live stream: full batches come out as they fill, the rest when the end of the replay passes all timers."""
    from skywright.sources.storage import run_dir
    from skywright.streaming import frames as live
    from skywright.streaming import replay

    path = f"{run_dir(spark)}/turns-{uuid.uuid4().hex}"
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.timestamp_seconds(F.col("turn") + 1_000_000_000).alias("at"))
    replay.ordered_files(c, ["turn", "role", "text"], path)
    rows = replay.replay_rows(spark, c.schema, path, pause=1, rows=-(-c.count() // 3), clock="steps", end="at")
    got = live.run_to_end(live.batches(rows, "conv_id", ["turn", "role", "text"], {"turns": "turn", "roles": "role"}, time="at", late="3650 days"))
    return got.select("conv_id", "batch_id", F.size("turns").cast("bigint").alias("n"), "turns", "roles")


def _paced_topics(spark, d) -> DataFrame:
    """The four sources as paced streams of topic/value rows, each in three steps."""
    from skywright.sources.storage import run_dir
    from skywright.streaming import frames as live
    from skywright.streaming import replay

    f, out = _files(spark, d), None
    social = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"), F.col("source").alias("hazard"))
    kinds = {"drone": exprs.is_drone_image, "gis": exprs.is_gis_image, "satellite": exprs.is_satellite_image}
    for kind in ("drone", "gis", "satellite", "social"):
        rows = social if kind == "social" else f.where(kinds[kind](F.col("name"))).select("path")
        path = f"{run_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        replay.ordered_files(rows, rows.columns[:1], path)
        stream = sinks.to_topic(live.paced_messages(spark, path, kind, -(-rows.count() // 3), "steps"), kind)
        out = stream if out is None else out.unionByName(stream)
    return out


def _topic_counts(rows: DataFrame) -> DataFrame:
    key = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in ("frame_id", "map_id", "image_id", "id")])
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"))


@query("stream_union", ORACLES["union_topics"])
def stream_union(spark, d):
    from skywright.streaming import frames as live

    return _topic_counts(live.run_to_end(_paced_topics(spark, d)))


@query("topic_log", f"WITH t AS ({ORACLES['union_topics']}) SELECT topic, n, n_keys, n AS n_offsets, TRUE AS dense FROM t")
def topic_log(spark, d):
    """The paced streams through a log of epochs, read back; dense: offsets of every partition go from 0 without a gap."""
    from skywright.sources.storage import run_dir

    folder = f"{run_dir(spark)}/log-{uuid.uuid4().hex}"
    running = sinks.write_log(_paced_topics(spark, d), folder, f"{folder}/state").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    rows = sinks.read_log(spark, folder)
    dense = rows.groupBy("topic", "partition").agg(F.count_distinct("offset").alias("offsets"), (F.max("offset") + 1 == F.count("*")).alias("dense"))
    dense = dense.groupBy("topic").agg(F.sum("offsets").alias("n_offsets"), F.every("dense").alias("dense"))
    return _topic_counts(rows).join(dense, "topic")


from skywright.plans import folders  # noqa: E402, F401  (registers its queries)
