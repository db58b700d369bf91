"""Declared row types of messages, frames, detections and labels, as DDL (a session is only needed where one is used)."""

from __future__ import annotations

from pyspark.sql import types as T

DRONE = "frame_id STRING, image_path STRING, timestamp DOUBLE, source STRING"
SATELLITE = "image_id STRING, image_path STRING, image_type STRING, timestamp DOUBLE, source STRING"
GIS = "map_id STRING, image_path STRING, timestamp DOUBLE, source STRING"
SOCIAL = "id STRING, text STRING, hazard STRING, timestamp DOUBLE, source STRING"
SOCIAL_INPUT = "id STRING, text STRING, hazard STRING"
ENVELOPE = "topic STRING, value STRING"
METADATA = "image_path STRING, source STRING, processed_at STRING, original_size ARRAY<INT>, processed_size ARRAY<INT>"
FRAME_RESULT = "status STRING, reason STRING, motion_score BIGINT, batch_id BIGINT"
DETECTION = T.StructType([T.StructField("class_id", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))])
YOLO_LABEL = "split STRING, stem STRING, line_no INT, class_id INT, xc DOUBLE, yc DOUBLE, w DOUBLE, h DOUBLE"
COCO = (
    "images ARRAY<STRUCT<id BIGINT, file_name STRING, width INT, height INT>>, "
    "annotations ARRAY<STRUCT<image_id BIGINT, category_id INT, damage_bbox ARRAY<DOUBLE>>>, "
    "categories ARRAY<STRUCT<id INT, name STRING>>"
)

#: Topic of each message kind, and the constant in its `source` field.
TOPICS = {"drone": "drone-video", "satellite": "satellite-imagery", "gis": "gis-data", "social": "social-posts"}
SOURCES = {"drone": "drone", "satellite": "satellite", "gis": "gis", "social": "twitter"}
#: Class names of the dataset descriptor.
CLASS_NAMES = {0: "damage_class_1", 1: "damage_class_2", 2: "damage_class_3"}
