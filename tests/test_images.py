"""Pixel operations, and the image source, on generated pictures."""

import math
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from skywright.functions import images
from skywright.operators import frames
from skywright.sources import files


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def picture(seed, h=160, w=200):
    rng = np.random.default_rng(seed)
    return images.resize(rng.integers(0, 256, (9, 9, 3), dtype=np.uint8), h, w)


def test_numpy_operations():
    a = picture(1)
    assert images.laplacian_variance(np.full((50, 60, 3), 7, np.uint8)) == 0
    assert images.resize(a, *a.shape[:2]).tolist() == a.tolist()
    assert images.resize(np.full((3, 5), 9, np.uint8), 32, 32).min() == 9
    near = np.clip(a.astype(int) + 3, 0, 255).astype(np.uint8)
    bits = lambda x, y: ((images.perceptual_hash(x) ^ images.perceptual_hash(y)) & (2**64 - 1)).bit_count()
    assert bits(a, near) <= 5 < bits(a, picture(2))
    x, y = np.zeros((2, 3), np.uint8), np.array([[25, 26, 255], [0, 0, 27]], np.uint8)
    assert images.motion_score(x, y) == images.motion_score(y, x) == 3
    assert images.gray(np.array([[[255, 0, 0]]], np.uint8))[0, 0] == 29  # blue


def test_folder_to_features(spark, tmp_path):
    png(tmp_path / "a.PNG", picture(1))
    png(tmp_path / "b.png", np.full((120, 120, 3), 9, np.uint8))
    png(tmp_path / "small.png", picture(3, 99, 200))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r["origin"].rsplit("/", 1)[-1]: r for r in images.features(files.images(spark, str(tmp_path))).withColumn("ok", frames.valid_size(F.col("height"), F.col("width"))).collect()}
    assert got["a.PNG"]["decoded"] and got["a.PNG"]["ok"] and got["a.PNG"]["phash"] == images.perceptual_hash(picture(1)[..., ::-1])
    assert not got["small.png"]["ok"] and not got["broken.png"]["decoded"]
    assert got["b.png"]["laplacian_var"] == 0 and len(got["b.png"]["gray320"]) == 320 * 320
    big = images.resized(files.images(spark, str(tmp_path))).collect()
    assert {len(r["data"]) for r in big} == {640 * 640 * 3} and len(big) == 3


def test_integer_formulas_pixel_by_pixel():
    """Luma, bilinear and windowed-sinc sizes and the hash, by plain loops over single pixels."""
    rng = np.random.default_rng(4)
    for h, w, oh, ow in [(13, 17, 5, 9), (6, 5, 11, 32), (40, 50, 32, 32), (1, 1, 3, 2)]:
        a = rng.integers(0, 256, (h, w, 3)).astype(int)
        g = [[(3735 * b + 19235 * gr + 9798 * r + 2**14) >> 15 for b, gr, r in row] for row in a.tolist()]
        assert images.gray(a.astype(np.uint8)).tolist() == g

        def axis(i, n, out):
            z = (i + 0.5) * (n / out) - 0.5
            low = math.floor(z)
            f = z - low
            if low < 0:
                low, f = 0, 0.0
            if low >= n - 1:
                low, f = n - 1, 0.0
            return low, min(low + 1, n - 1), round(f * 2048)

        small = []
        for y in range(oh):
            y0, y1, fy = axis(y, h, oh)
            for x in range(ow):
                x0, x1, fx = axis(x, w, ow)
                s0, s1 = (g[k][x0] * (2048 - fx) + g[k][x1] * fx for k in (y0, y1))
                small.append(max(0, min(255, (((2048 - fy) * (s0 >> 4)) >> 16) + ((fy * (s1 >> 4)) >> 16) + 2 >> 2)))
        assert images.resize(np.array(g, np.uint8), oh, ow).ravel().tolist() == small

        def kernel(i, n, out):
            scale = n / out
            stretch = max(scale, 1.0)
            c = (i + 0.5) * scale
            low, high = max(int(c - 3 * stretch + 0.5), 0), min(int(c + 3 * stretch + 0.5), n)
            sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
            k = [sinc(t) * sinc(t / 3) if -3 <= t < 3 else 0.0 for t in ((x - c + 0.5) / stretch for x in range(low, high))]
            return low, [int(v / sum(k) * 2**22 + (-0.5 if v / sum(k) < 0 else 0.5)) for v in k]

        clip = lambda v: max(0, min(255, (v + 2**21) >> 22))
        rows = g if w == ow else [[clip(sum(k * row[low + j] for j, k in enumerate(ks))) for low, ks in (kernel(x, w, ow) for x in range(ow))] for row in g]
        out = rows if h == oh else [[clip(sum(k * rows[low + j][x] for j, k in enumerate(ks))) for x in range(ow)] for low, ks in (kernel(y, h, oh) for y in range(oh))]
        assert images.reduce(np.array(g, np.uint8), oh, ow).tolist() == out
        luma = [[(7471 * b + 38470 * gr + 19595 * r + 2**15) >> 16 for b, gr, r in row] for row in a.tolist()]
        small = images.reduce(np.array(luma, np.uint8), 32, 32)
        low = [sum(int(small[y, x]) * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
        bits = sum(1 << 63 - i for i, c in enumerate(low) if c > np.median(low))
        assert images.perceptual_hash(a.astype(np.uint8)) & (2**64 - 1) == bits or h == 1  # one colour: all but one coefficient are rounding
