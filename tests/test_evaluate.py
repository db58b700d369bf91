"""Average precision against numpy's own interpolation, box by box."""

import random

import numpy as np
import pytest

from skywright.operators import evaluate


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def precision_by_hand(detections, truth, t, c):
    """Each detection takes the box it overlaps most, each box keeps the most confident one; then the curve as numpy draws it."""
    hits = []
    found = set()
    for image, _, down, tie, box in sorted((d for d in detections if d[1] == c), key=lambda d: (d[2], d[0], d[3])):
        mine = [(-overlap(box, g), g) for i, k, g in truth if (i, k) == (image, c)]
        best = min(mine) if mine else (0.0, None)
        ok = -best[0] >= t and best[0] < 0 and (image, str(best[1])) not in found
        if ok:
            found.add((image, str(best[1])))
        hits.append(ok)
    n = sum(k == c for _, k, _ in truth)
    if not hits:
        return 0.0
    tp = np.cumsum(hits)
    recall, precision = np.concatenate([[0.0], tp / n, [1.0]]), np.concatenate([[1.0], tp / np.arange(1, len(tp) + 1), [0.0]])
    precision = np.flip(np.maximum.accumulate(np.flip(precision)))
    x = np.linspace(0, 1, 101)
    return float(np.trapezoid(np.interp(x, recall, precision), x))


def boxes(rng, images, per, jitter):
    detections, truth = [], []
    for i in range(images):
        for _ in range(rng.randint(0, per)):
            c, x, y = rng.randrange(4), rng.randint(0, 30), rng.randint(0, 30)
            g = [float(x), float(y), x + rng.randint(5, 20) + 0.0, y + rng.randint(5, 20) + 0.0]
            if c != 3:
                truth.append((i, c, g))
            for _ in range(rng.randint(0, 3)):
                detections.append((i, c if rng.random() < 0.9 else 5, -rng.randint(1, 40) / 40, len(detections), [v + rng.uniform(-jitter, jitter) for v in g]))
        detections.append((i, rng.randrange(4), -rng.random(), len(detections), [0.0, 0.0, 0.0, 9.0]))
    return detections, truth


@pytest.mark.parametrize("images, per, jitter, pieces", [(60, 6, 2.0, 5), (12, 3, 0.5, 1), (3, 1, 0.0, 7), (40, 12, 4.0, 16)])
def test_average_precision(spark, images, per, jitter, pieces):
    detections, truth = boxes(random.Random(images), images, per, jitter)
    truth.append((0, 7, [0.0, 0.0, 5.0, 5.0]))  # a class without detections
    d = spark.createDataFrame(detections, "image int, class_id int, down double, tie int, bbox array<double>")
    g = spark.createDataFrame(truth, "image int, class_id int, bbox array<double>")
    by_class = evaluate.average_precision(d, g, "image", ["down", "image", "tie"], pieces=pieces)
    rows = by_class.collect()
    classes = sorted({c for _, c, _ in truth})
    assert sorted((r["class_id"], r["threshold"]) for r in rows) == [(c, t) for c in classes for t in evaluate.THRESHOLDS]
    want = {(c, t): precision_by_hand(detections, truth, t, c) for c in classes for t in evaluate.THRESHOLDS}
    for r in rows:
        assert r["ap"] == pytest.approx(want[r["class_id"], r["threshold"]], abs=1e-9), r
        assert r["n_truth"] == sum(k == r["class_id"] for _, k, _ in truth) and r["n_detections"] == sum(x[1] == r["class_id"] for x in detections)
    got = evaluate.mean_precision(by_class).first()
    assert got["n_classes"] == len(classes) and got["map50"] == pytest.approx(np.mean([want[c, 0.5] for c in classes])) and got["map50_95"] == pytest.approx(np.mean(list(want.values())))


def test_perfect_and_empty(spark):
    truth = [(i, 0, [0.0, 0.0, 10.0, 10.0]) for i in range(10)]
    g = spark.createDataFrame(truth, "image int, class_id int, bbox array<double>")
    d = spark.createDataFrame([(i, 0, -0.9, i, b) for i, _, b in truth], "image int, class_id int, down double, tie int, bbox array<double>")
    ap = lambda d, g: [r["ap"] for r in evaluate.average_precision(d, g, "image", ["down", "image", "tie"], (0.5,)).collect()]
    assert ap(d, g) == [pytest.approx(0.995)]  # the curve ends at precision 0
    assert ap(d.limit(0), g) == [0.0] and ap(d, g.limit(0)) == []
