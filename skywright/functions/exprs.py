"""Column expressions: names and paths, messages, box geometry, hashes. All built-in, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skywright.sources.schemas import SOURCES


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(name: Column) -> Column:
    """The name without its last extension; leading dots are part of the name."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def label_file(name: Column) -> Column:
    return F.concat(stem(name), F.lit(".txt"))


def has_extension(name: Column, extensions: tuple[str, ...], any_case: bool = True) -> Column:
    name = F.lower(name) if any_case else name
    out = F.lit(False)
    for e in extensions:
        out = out | name.endswith(e)
    return out


def is_drone_image(name: Column) -> Column:
    return has_extension(name, (".jpg",))


def is_gis_image(name: Column) -> Column:
    return has_extension(name, (".jpg", ".jpeg", ".png"))


def is_satellite_image(name: Column) -> Column:
    return has_extension(name, (".tif", ".tiff"))


def is_frame_strict(name: Column) -> Column:
    """Case-sensitive variant of the frame loop."""
    return has_extension(name, (".jpg",), any_case=False)


def image_type(path: Column) -> Column:
    """pre, post or unknown by the directory alone; pre wins."""
    d = F.lower(directory(path))
    return F.when(d.contains("pre"), "pre").when(d.contains("post"), "post").otherwise("unknown")


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def drone_message(path: Column, timestamp: Column) -> list[Column]:
    return [base_name(path).alias("frame_id"), path.alias("image_path"), timestamp.cast("double").alias("timestamp"), F.lit(SOURCES["drone"]).alias("source")]


def gis_message(path: Column, timestamp: Column) -> list[Column]:
    return [base_name(path).alias("map_id"), path.alias("image_path"), timestamp.cast("double").alias("timestamp"), F.lit(SOURCES["gis"]).alias("source")]


def satellite_message(path: Column, timestamp: Column) -> list[Column]:
    return [base_name(path).alias("image_id"), path.alias("image_path"), image_type(path).alias("image_type"), timestamp.cast("double").alias("timestamp"), F.lit(SOURCES["satellite"]).alias("source")]


def social_message(id_: Column, text: Column, hazard: Column, timestamp: Column) -> list[Column]:
    return [id_.cast("string").alias("id"), or_empty(text).alias("text"), hazard.alias("hazard"), timestamp.cast("double").alias("timestamp"), F.lit(SOURCES["social"]).alias("source")]


def wire(*columns: str | Column) -> Column:
    """JSON of the columns with nulls written as null, as a Kafka value."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def usable_box(box: Column) -> Column:
    """Four numbers with a positive extent; a null box is not usable."""
    return F.coalesce((F.size(box) == 4) & (F.get(box, 2) > 0) & (F.get(box, 3) > 0), F.lit(False))


def normalised_box(box: Column, width: Column, height: Column) -> list[Column]:
    """Centre and size of a pixel box (x, y, w, h) as shares of the image; not clipped."""
    x, y, w, h = (F.get(box, i) for i in range(4))
    return [((x + w / 2) / width).alias("xc"), ((y + h / 2) / height).alias("yc"), (w / width).alias("w"), (h / height).alias("h")]


def pixel_corners(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Whole-number corners of a normalised box, truncated towards zero."""
    cx, cy, bw, bh = xc * width, yc * height, w * width, h * height
    cut = lambda c, name: c.cast("int").alias(name)
    return [cut(cx - bw / 2, "x1"), cut(cy - bh / 2, "y1"), cut(cx + bw / 2, "x2"), cut(cy + bh / 2, "y2")]


def class_of(category: Column) -> Column:
    return (category - 1).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(values: Column) -> Column:
    """64 bits of a vector: bit i is set where element i is above zero."""
    bits = F.transform(F.slice(values, 1, 64), lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def changed_elements(previous: Column, current: Column, delta: float = 25) -> Column:
    """How many elements differ by more than delta."""
    return F.size(F.filter(F.zip_with(previous, current, lambda a, b: F.abs(a - b)), lambda d: d > delta)).cast("bigint")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two corner boxes (x1, y1, x2, y2)."""
    g = F.get
    side = lambda lo, hi: F.greatest(F.least(g(a, hi), g(b, hi)) - F.greatest(g(a, lo), g(b, lo)), F.lit(0.0))
    area = lambda z: (g(z, 2) - g(z, 0)) * (g(z, 3) - g(z, 1))
    inter = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def detection(class_id: Column, confidence: Column, bbox: Column) -> Column:
    return F.struct(class_id.cast("int").alias("class_id"), confidence.cast("double").alias("confidence"), bbox.cast("array<double>").alias("bbox"))


def zip_shorter(a: Column, b: Column, left: str, right: str) -> Column:
    """Pairs of two arrays by position, as long as the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias(left), y.alias(right)))


def processed_at() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
