"""Quality classifier: supervised subword embeddings in the manner of fastText, trained by numpy stochastic gradient descent.

A text is the average of learned vectors: one hashed vector for each word, for each character n-gram of the word, and for each pair of
neighbouring words; a softmax layer turns it into label probabilities. Because both steps before the softmax are linear, a trained model folds
into two numbers a bucket (its logit difference and a count of 1), so scoring a word that was seen before is one look-up.

Training takes a bounded sample of labelled texts to the driver (`sample_rows` and `sample_chars`, documented parameters): the rows whose
ids hash lowest. Scoring reads whole texts in a narrow Arrow stage without shuffle.

The score is the softmax probability of label 1 with its logit shrunk towards the labels' share: by count / (count + `TRUST`) for a text of
`count` features, since an average over few vectors says little. `trust=0` gives the plain probability.

Defined cases: a null or empty text has no features and gets the score of the label shares; labels other than 0 and 1 are not learned
from; without labels of both kinds the score is that share for every text; rows that repeat id, label and text count once in training and are
scored alike; an id with both labels is learned with both; very long texts are scored whole, one at a time; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, sample_by_hash

BUCKETS = 1 << 18
NGRAMS = (3, 4)
#: Features at which a text's own evidence counts as much as the share of label 1 in the sample.
TRUST = 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Features:
    """Hashed features of words, for many words at once; memo: word -> its place among the words seen."""

    def __init__(self, buckets: int = BUCKETS, memo_words: int = 300_000):
        self.buckets, self.memo_words = np.uint64(buckets), memo_words
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.hash = np.empty(0, np.uint64)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, flat buckets of words and n-grams, index of the word of each bucket)."""
        data = [("<" + w + ">").encode("utf-8", "surrogatepass") for w in words]
        whole = _mixed(np.array([zlib.crc32(d) for d in data], np.uint64) + np.uint64(1 << 40))
        lengths = np.array([len(d) for d in data], np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        word = np.repeat(np.arange(len(data)), lengths)
        buckets, of = [whole % self.buckets], [np.arange(len(data))]
        for n in NGRAMS:
            if len(flat) >= n:
                h = np.full(len(flat) - n + 1, n, np.uint64)
                for k in range(n):
                    h = h * np.uint64(257) + flat[k : len(flat) - n + 1 + k]
                inside = word[: len(h)] == word[n - 1 :]
                buckets.append(_mixed(h[inside]) % self.buckets)
                of.append(word[: len(h)][inside])
        return whole, np.concatenate(buckets), np.concatenate(of)

    def places(self, lists: list[list[str]], learned) -> list[np.ndarray]:
        """Place of every word in the memo; learned(words) is called with new words, in the order of their places."""
        if len(self.memo) > self.memo_words:
            self.reset()
            learned(None)
        new = list({w for ws in lists for w in ws if w not in self.memo})
        if new:
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            learned(new)
        at = self.memo.__getitem__
        return [np.fromiter(map(at, ws), np.int64, len(ws)) for ws in lists]

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """Buckets of neighbouring words; a word that follows itself shares bucket 0 with all such words."""
        return np.where(hashes[:-1] == hashes[1:], np.uint64(0), _mixed(hashes[:-1] * np.uint64(31) + hashes[1:]) % self.buckets)


@dataclass
class Model:
    logit: np.ndarray  # of each bucket: what it adds to the difference of both labels' logits
    bias: float
    share: float
    trust: float = TRUST

    def probability(self, total: float, count: int) -> float:
        if not count:
            return self.share
        trust = count / (count + self.trust)
        z = trust * (total / count + self.bias) + (1 - trust) * np.log(self.share / (1 - self.share))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], labels: np.ndarray, dim: int = 8, epochs: int = 12, rate: float = 0.5, buckets: int = BUCKETS, seed: int = 7) -> Model:
    """Plain SGD, one text a step, with a falling rate; labels weigh as if both were equally frequent, up to the score's cut at 0.3."""
    n = len(texts)
    share = round(float((labels.sum() + 1) / (n + 2)), 6)
    if n == 0 or labels.all() or not labels.any():
        return Model(np.zeros(buckets, np.float32), 0.0, share)
    f = Features(buckets, memo_words=1 << 60)
    starts: list[np.ndarray] = [np.empty(0, np.int64)]
    pools: list[np.ndarray] = []
    hashes: list[np.ndarray] = []

    def learned(words) -> None:
        h, b, of = f.of_words(words)
        order = np.argsort(of, kind="stable")
        pools.append(b[order].astype(np.int32))
        starts.append(np.bincount(of, minlength=len(words)))
        hashes.append(h)

    at = f.places([t.split() for t in texts], learned)
    pool, length = np.concatenate(pools) if pools else np.empty(0, np.int32), np.concatenate(starts)
    begin, h = np.cumsum(length) - length, np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    docs = []
    for a in at:
        k, count = np.unique(a, return_counts=True)
        grams = pool[np.arange(int(length[k].sum())) + np.repeat(begin[k] - (np.cumsum(length[k]) - length[k]), length[k])]
        both = np.concatenate([grams, f.pairs(h[a]).astype(np.int32)])
        weight = np.concatenate([np.repeat(count, length[k]), np.ones(max(len(a) - 1, 0), np.int64)])
        ids, inverse = np.unique(both, return_inverse=True)
        docs.append((ids.astype(np.int32), (np.bincount(inverse, weight, len(ids)) / max(weight.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    weigh = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    steps, done = epochs * n, 0
    for _ in range(epochs):
        for i in rng.permutation(n):
            ids, w = docs[i]
            if not len(ids):
                continue
            lr = rate * (1 - done / steps)
            done += 1
            hidden = w @ table[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1.0
            g = lr * weigh[i] * p
            back = out @ g
            out -= np.outer(hidden, g)
            bias -= g
            table[ids] -= w[:, None] * back[None, :] * len(ids) ** 0.5
    diff = out[:, 1] - out[:, 0]
    return Model((table @ diff).astype(np.float32), float(bias[1] - bias[0]), share)


class Scorer:
    """Scores texts with memoised sums of each word's buckets."""

    def __init__(self, model: Model):
        self.m, self.f = model, Features(len(model.logit))
        self._clear()

    def _clear(self) -> None:
        self.sum, self.count, self.hash = np.empty(0, np.float64), np.empty(0, np.int64), np.empty(0, np.uint64)

    def _learned(self, words) -> None:
        if words is None:
            return self._clear()
        for at in range(0, len(words), 50_000):
            h, b, of = self.f.of_words(words[at : at + 50_000])
            n = len(words[at : at + 50_000])
            self.sum = np.concatenate([self.sum, np.bincount(of, self.m.logit[b], n)])
            self.count = np.concatenate([self.count, np.bincount(of, minlength=n)])
            self.hash = np.concatenate([self.hash, h])

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for a in self.f.places([(t or "").split() for t in texts], self._learned):
            pairs = self.f.pairs(self.hash[a])
            out.append(self.m.probability(self.sum[a].sum() + self.m.logit[pairs].sum(dtype=np.float64), int(self.count[a].sum()) + len(pairs)))
        return out


_SCORERS: dict[str, Scorer] = {}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000, sample_chars: int = 24_000_000, **how) -> Model:
    """labels: id and label of the rows to learn from; at most sample_rows of them, and no further text once sample_chars are reached."""
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1))
    sample = sample_by_hash(usable, "__id", sample_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).join(F.broadcast(sample), "__id").select(F.xxhash64("__id").alias("o"), "__id", "__label", "__t").distinct()
    got, size = [], 0
    for r in rows.toLocalIterator():  # a partition of the sample at a time
        got.append((r[0], r[1], r[2], r[3] or ""))
        size += len(got[-1][3])
        while size > sample_chars:
            got.sort(key=lambda x: x[:3])
            size -= len(got.pop()[3])
    got.sort(key=lambda x: (*x[:3], x[3]))
    return train([x[3] for x in got], np.array([x[2] for x in got], np.int64), **how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score, the probability of label 1, of every row."""
    import pyarrow as pa

    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(sent.value)
        s = _SCORERS[key]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [x for a, b in chunks(texts) for x in s.scores(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
