"""Pixel operations on decoded images (BGR bytes), in numpy, and one Arrow stage that computes every feature from one decode."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Integer luma weights of blue, green, red and their bits: of gray images for motion and blur, and of those for hashes.
LUMA, LUMA_BITS = np.array([3735, 19235, 9798]), 15
HASH_LUMA, HASH_LUMA_BITS = np.array([7471, 38470, 19595]), 16
#: Bits of bilinear weights, bits of windowed-sinc weights, and lobes of the sinc.
LINEAR_BITS, SINC_BITS, LOBES = 11, 22, 3
#: Side of the motion image, and of the working image.
MOTION_SIDE = 320
WORK_SIDE = 640

FEATURE_SCHEMA = "origin string, height int, width int, n_channels int, decoded boolean, phash bigint, laplacian_var double, gray320 binary"


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def encode_png(image: np.ndarray) -> bytes:
    """A PNG file of a gray or RGB byte image."""
    import struct
    import zlib

    height, width = image.shape[:2]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + image[y].tobytes() for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def gray(image: np.ndarray, weights: np.ndarray = LUMA, bits: int = LUMA_BITS) -> np.ndarray:
    """Luma in integers, rounded by half a unit; one-channel images stay."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    return ((image[..., :3].astype(np.int64) @ weights + (1 << bits - 1)) >> bits).astype(np.uint8)


def _axis(n: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, second place, weight of the second in 1 / 2048) for each place of an axis that is resized bilinearly."""
    at = (np.arange(out) + 0.5) * (n / out) - 0.5
    low = np.floor(at).astype(np.int64)
    part = np.where((low < 0) | (low >= n - 1), 0.0, at - low)
    low = np.clip(low, 0, n - 1)
    return low, np.minimum(low + 1, n - 1), np.rint(part * (1 << LINEAR_BITS)).astype(np.int64)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with half-pixel centres in fixed point: rows first in 11 bits, then columns; the aspect ratio is not kept."""
    if image.ndim == 3:
        return np.stack([resize(image[..., c], height, width) for c in range(image.shape[2])], -1)
    one = 1 << LINEAR_BITS
    x0, x1, fx = _axis(image.shape[1], width)
    y0, y1, fy = _axis(image.shape[0], height)
    wide = image.astype(np.int64)
    wide = wide[:, x0] * (one - fx) + wide[:, x1] * fx >> 4
    out = ((one - fy)[:, None] * wide[y0] >> 16) + (fy[:, None] * wide[y1] >> 16) + 2 >> 2
    return np.clip(out, 0, 255).astype(np.uint8)


def sinc_weights(n: int, out: int) -> np.ndarray:
    """Integer weights (out, n) of a windowed-sinc reduction; the window spans LOBES places of the smaller of both sides."""
    scale = n / out
    stretch = max(scale, 1.0)
    reach, weights = LOBES * stretch, np.zeros((out, n), np.int64)
    for i in range(out):
        centre = (i + 0.5) * scale
        low, high = max(int(centre - reach + 0.5), 0), min(int(centre + reach + 0.5), n)
        x = (np.arange(low, high) - centre + 0.5) / stretch
        w = np.where((x >= -LOBES) & (x < LOBES), np.sinc(x) * np.sinc(x / LOBES), 0.0)
        w = w / w.sum() * (1 << SINC_BITS)
        weights[i, low:high] = np.trunc(w + np.where(w < 0, -0.5, 0.5)).astype(np.int64)
    return weights


def reduce(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A gray image at another size by windowed sincs: rows first, then columns, each rounded to bytes."""
    half = 1 << SINC_BITS - 1
    rows = np.clip(image.astype(np.int64) @ sinc_weights(image.shape[1], width).T + half >> SINC_BITS, 0, 255) if image.shape[1] != width else image.astype(np.int64)
    out = np.clip(sinc_weights(image.shape[0], height) @ rows + half >> SINC_BITS, 0, 255) if image.shape[0] != height else rows
    return out.astype(np.uint8)


def laplacian_variance(image: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian with mirrored borders (the border itself is not repeated)."""
    g = np.pad(gray(image).astype(np.float64), 1, mode="reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits of the low 8x8 cosine coefficients of the luma image, reduced to 32x32: set where above their median; as a signed integer."""
    small = reduce(gray(image, HASH_LUMA, HASH_LUMA_BITS), 32, 32).astype(np.float64)
    k, n = np.arange(32)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * k * (2 * n + 1) / 64)
    low = (basis @ small @ basis.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def motion_score(previous: np.ndarray, current: np.ndarray, delta: int = 25) -> int:
    """Pixels that differ by more than delta."""
    return int((np.abs(previous.astype(np.int16) - current.astype(np.int16)) > delta).sum())


def features(images: DataFrame) -> DataFrame:
    """One row of features for each row of the `image` source; an image that did not decode has decoded = false."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = {f: [] for f in ("origin", "height", "width", "n_channels", "decoded", "phash", "laplacian_var", "gray320")}
            for row in batch.column(0).to_pylist():
                ok = row is not None and row["height"] > 0 and row["width"] > 0
                image = pixels(row["data"], row["height"], row["width"], row["nChannels"]) if ok else None
                values = (row and row["origin"], row and row["height"], row and row["width"], row and row["nChannels"], ok)
                more = (perceptual_hash(image), laplacian_variance(image), resize(gray(image), MOTION_SIDE, MOTION_SIDE).tobytes()) if ok else (None, None, None)
                for f, v in zip(out, values + more, strict=True):
                    out[f].append(v)
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return images.select("image").mapInArrow(run, FEATURE_SCHEMA)


def resized(images: DataFrame, height: int = WORK_SIDE, width: int = WORK_SIDE) -> DataFrame:
    """origin and the pixels at the working size."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            origin, data = [], []
            for row in batch.column(0).to_pylist():
                if row is not None and row["height"] > 0:
                    origin.append(row["origin"])
                    data.append(resize(pixels(row["data"], row["height"], row["width"], row["nChannels"]), height, width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(origin, pa.string()), pa.array([height] * len(origin), pa.int32()), pa.array([width] * len(origin), pa.int32()), pa.array(data, pa.binary())], ["origin", "height", "width", "data"])

    return images.select("image").mapInArrow(run, "origin string, height int, width int, data binary")


def picture_numbers(pictures: DataFrame, key: str, data: str, height: int, width: int, channels: int, side: int) -> DataFrame:
    """key, gray, laplacian (the variance times the squared number of pixels), small (bilinear, side x side), thumb (windowed sinc) and phash of raw pictures."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                image = pixels(raw, height, width, channels)
                g = gray(image)
                pad = np.pad(g.astype(np.int64), 1, mode="reflect")
                lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * pad[1:-1, 1:-1]
                thumb = reduce(gray(image, HASH_LUMA, HASH_LUMA_BITS), side, side)
                rows.append((g.ravel().tolist(), int(lap.size * (lap * lap).sum() - lap.sum() ** 2), resize(g, side, side).ravel().tolist(), thumb.ravel().tolist(), perceptual_hash(image)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, "gray", "laplacian", "small", "thumb", "phash"])

    kind = pictures.schema[key].dataType.simpleString()
    return pictures.select(key, data).mapInArrow(run, f"{key} {kind}, gray array<int>, laplacian bigint, small array<int>, thumb array<int>, phash bigint")
