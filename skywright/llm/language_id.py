"""Language identification of code-switched text by a linear-chain conditional random field over words.

Each word (white-space token with a letter) has hashed features: its lexicon entry, its affixes and its character n-grams. Their
weights and the transitions between languages are learned by stochastic gradient descent on the exact likelihood; training sequences
put stretches of texts in different languages after each other, so that transitions learn how rarely a switch happens. Labels come
from forward-backward: a text is cut into blocks of words whose transfer matrices are made for all blocks at once, so the number of
numpy steps depends on the block length and on the longest text's blocks, never on the number of words.

Training takes a bounded sample of texts to the driver (`sample_rows`, `sample_chars`). Labelling reads whole texts in a narrow Arrow
stage without shuffle.

Defined cases: a text that is null or has no letter is `und` with score 0; rows with a null language are not learned from; with one
language only, every text with a letter gets it; without any, every text is `und`; equal totals go to the first language in order;
rows that repeat id, language and text count once in training and are labelled alike; very long texts are labelled whole, one at a time; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, sample_by_hash

BUCKETS = 1 << 17
UNKNOWN = "und"
BLOCK = 64


def letters(token: str) -> str:
    """The letters of a token, lower-cased."""
    return token.lower() if token.isalpha() else "".join(c for c in token if c.isalpha()).lower()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of all features of all words: lexicon entry, n-grams of the marked word's bytes, and affixes of the same lengths."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    lengths = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(data)), lengths)
    ends = np.cumsum(lengths)
    hashes, of = [np.array([zlib.crc32(d) for d in data], np.uint64)], [np.arange(len(data))]
    for n in (2, 3, 4):
        at = np.flatnonzero(word[: len(flat) - n + 1] == word[n - 1 :]) if len(flat) >= n else np.empty(0, np.int64)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + flat[at + k]
        w = word[at]
        head, tail = at == ends[w] - lengths[w], at == ends[w] - n
        hashes += [h, h[head] + np.uint64(1 << 45), h[tail] + np.uint64(1 << 46)]
        of += [w, w[head], w[tail]]
    return (_mixed(np.concatenate(hashes)) % np.uint64(buckets)).astype(np.int64), np.concatenate(of)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (buckets, K)
    trans: np.ndarray  # (K, K): log potentials from row to column
    start: np.ndarray  # (K,)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Mean of the features' weights times the square root of their number: long words say more, but not in proportion."""
        flat, of = features(words, len(self.weights))
        out = np.zeros((len(words), len(self.langs)), np.float64)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(of, self.weights[flat, k], len(words))
        return out / np.sqrt(np.maximum(np.bincount(of, minlength=len(words)), 1))[:, None]


def _scaled(e: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(e - e.max(-1, keepdims=True), -40.0))


def marginals(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marginals, forward and backward messages, and both potentials, of equally long sequences of log emissions (B, L, K)."""
    x, t = _scaled(e), np.exp(trans - trans.max())
    a, b = np.empty_like(x), np.ones_like(x)
    m = x[:, 0] * _scaled(start)
    a[:, 0] = m / m.sum(-1, keepdims=True)
    for i in range(1, x.shape[1]):
        m = (a[:, i - 1] @ t) * x[:, i]
        a[:, i] = m / m.sum(-1, keepdims=True)
    for i in range(x.shape[1] - 2, -1, -1):
        m = (x[:, i + 1] * b[:, i + 1]) @ t.T
        b[:, i] = m / m.sum(-1, keepdims=True)
    p = a * b
    return p / p.sum(-1, keepdims=True), a, b, x, t


def train(texts: list[str], langs: list[str], epochs: int = 4, length: int = 48, rate: float = 0.5, buckets: int = BUCKETS, seed: int = 11) -> Model:
    names = sorted(set(langs))
    k = len(names)
    model = Model(names, np.zeros((buckets, k)), np.zeros((k, k)), np.zeros(k))
    rng = np.random.default_rng(seed)
    memo: dict[str, int] = {}
    pieces: list[tuple[np.ndarray, int]] = []  # stretches of words of one language
    for text, lang in zip(texts, langs, strict=True):
        words = [w for w in map(letters, text.split()) if w]
        at = []
        for w in words:
            if w not in memo:
                memo[w] = len(memo)
            at.append(memo[w])
        cuts = range(0, len(at), length // 2)
        pieces += [(np.array(at[i : i + length // 2]), names.index(lang)) for i in cuts]
    if k < 2 or not pieces:
        return model
    words = np.concatenate([p for p, _ in pieces])
    label = np.concatenate([np.full(len(p), c) for p, c in pieces])
    ends = np.cumsum([len(p) for p, _ in pieces])
    starts = ends - [len(p) for p, _ in pieces]
    pool, owner = features(list(memo), buckets)
    pool, n = pool[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(memo))
    begin = np.cumsum(n) - n
    square, tsquare, ssquare = np.full((buckets, k), 1e-3), np.full((k, k), 1e-3), np.full(k, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        flat = np.concatenate([np.arange(starts[i], ends[i]) for i in order])
        rows = len(flat) // length
        if rows == 0:
            flat, rows = np.resize(flat, length), 1
        flat = flat[: rows * length].reshape(rows, length)
        for at in range(0, rows, 32):
            w, y = words[flat[at : at + 32]], label[flat[at : at + 32]]
            u, inv = np.unique(w, return_inverse=True)
            f = pool[np.arange(int(n[u].sum())) + np.repeat(begin[u] - (np.cumsum(n[u]) - n[u]), n[u])]
            of, root = np.repeat(np.arange(len(u)), n[u]), np.sqrt(n[u])
            eu = np.stack([np.bincount(of, model.weights[f, c], len(u)) for c in range(k)], 1) / root[:, None]
            e = eu[inv.reshape(w.shape)]
            p, a, b, x, t = marginals(e, model.trans, model.start)
            g = p.copy()
            np.put_along_axis(g, y[..., None], np.take_along_axis(g, y[..., None], -1) - 1.0, -1)
            pair = a[:, :-1, :, None] * t * (x[:, 1:] * b[:, 1:])[:, :, None, :]
            pair /= pair.sum((-1, -2), keepdims=True)
            gt = pair.sum((0, 1))
            np.add.at(gt, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0)
            gu = np.stack([np.bincount(inv.ravel(), g[..., c].ravel(), len(u)) for c in range(k)], 1) / root[:, None]
            fu, finv = np.unique(f, return_inverse=True)
            gf = np.stack([np.bincount(finv, gu[of, c], len(fu)) for c in range(k)], 1) / len(w)
            gt, gs = gt / len(w), g[:, 0].sum(0) / len(w)
            square[fu] += gf**2
            model.weights[fu] -= rate * gf / np.sqrt(square[fu])
            tsquare += gt**2
            model.trans -= rate * 0.2 * gt / np.sqrt(tsquare)
            ssquare += gs**2
            model.start -= rate * 0.2 * gs / np.sqrt(ssquare)
    return model


class Labeller:
    def __init__(self, model: Model, memo_words: int = 300_000):
        self.m, self.memo_words = model, memo_words
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.e = np.empty((0, len(self.m.langs)))
        self.real = np.empty(0, bool)

    def _places(self, texts: list[str | None]) -> list[np.ndarray]:
        """Places in the memo of the tokens with letters."""
        lists = [(t or "").split() for t in texts]
        if len(self.memo) > self.memo_words:
            self._reset()
        new = list({w for ws in lists for w in ws if w not in self.memo})
        for i in range(0, len(new), 20_000):
            block = new[i : i + 20_000]
            words = list(map(letters, block))
            self.memo.update(zip(block, range(len(self.memo), len(self.memo) + len(block)), strict=True))
            self.e = np.concatenate([self.e, self.m.emissions(words)])
            self.real = np.concatenate([self.real, np.array([bool(w) for w in words], bool)])
        at = self.memo.__getitem__
        found = [np.fromiter(map(at, ws), np.int64, len(ws)) for ws in lists]
        return [a[self.real[a]] for a in found]

    def posteriors(self, texts: list[str | None]) -> list[np.ndarray]:
        """(words, K) label probabilities of each text, by forward-backward over blocks."""
        places = self._places(texts)
        k = len(self.m.langs)
        sizes = np.array([len(a) for a in places], np.int64)
        if k < 2 or not sizes.sum():
            return [np.ones((len(a), k)) for a in places]
        n_blocks = -(-sizes // BLOCK)
        first = np.cumsum(n_blocks) - n_blocks
        total = int(n_blocks.sum())
        x = np.ones((total, BLOCK, k))
        used = np.zeros((total, BLOCK), bool)
        flat = np.concatenate(places)
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        block, slot = np.repeat(first, sizes) + inside // BLOCK, inside % BLOCK
        x[block, slot] = _scaled(self.e[flat])
        used[block, slot] = True
        t = np.exp(self.m.trans - self.m.trans.max())
        full = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for i in range(BLOCK):  # transfer matrices; a padded slot changes nothing
            step = (full.reshape(-1, k) @ t).reshape(total, k, k) * x[:, None, i]
            step /= step.max((1, 2), keepdims=True)
            full = np.where(used[:, i, None, None], step, full)
        # Messages into each block from the left and from the right, for all texts in step.
        left, right = np.empty((total, k)), np.ones((total, k))
        order = np.arange(len(sizes))
        m = np.tile(np.nan, (len(sizes), k))
        for j in range(int(n_blocks.max())):
            live = order[n_blocks > j]
            at = first[live] + j
            if j:
                left[at] = m[live]
                out = np.einsum("bk,bkl->bl", m[live], full[at])
            else:
                left[at] = np.nan  # a text's first block has no message; the start potentials take its place
                out = self._first(x[at], used[at], t)
            m[live] = out / out.sum(-1, keepdims=True)
        m = np.ones((len(sizes), k))
        for j in range(int(n_blocks.max()) - 1, -1, -1):
            live = order[n_blocks > j]
            at = first[live] + j
            right[at] = m[live]
            out = np.einsum("bkl,bl->bk", full[at], m[live])
            m[live] = out / out.sum(-1, keepdims=True)
        a, b = np.empty_like(x), np.empty_like(x)
        head = np.isnan(left[:, 0])
        now = np.where(head[:, None], 0.0, left)
        for i in range(BLOCK):
            step = (now @ t) * x[:, i]
            if i == 0:
                step[head] = _scaled(self.m.start) * x[head, 0]
            step /= np.maximum(step.sum(-1, keepdims=True), 1e-300)
            now = np.where(used[:, i, None], step, now)
            a[:, i] = now
        now = right
        for i in range(BLOCK - 1, -1, -1):
            b[:, i] = now
            step = (x[:, i] * now) @ t.T
            step /= np.maximum(step.sum(-1, keepdims=True), 1e-300)
            now = np.where(used[:, i, None], step, now)
        p = (a * b)[block, slot]
        p /= p.sum(-1, keepdims=True)
        return np.split(p, np.cumsum(sizes)[:-1])

    def _first(self, x: np.ndarray, used: np.ndarray, t: np.ndarray) -> np.ndarray:
        m = _scaled(self.m.start) * x[:, 0]
        for i in range(1, BLOCK):
            step = (m @ t) * x[:, i]
            step /= step.sum(-1, keepdims=True)
            m = np.where(used[:, i, None], step, m)
        return m

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, its share of the text's words, runs of words with their language) of each text; words are those with letters."""
        out = []
        for p in self.posteriors(texts):
            if not len(p) or not self.m.langs:
                out.append((UNKNOWN, 0.0, []))
                continue
            mean = p.mean(0)
            best = int(np.argmax(mean))
            each = p.argmax(1)
            cuts = np.flatnonzero(np.diff(each)) + 1
            runs = zip([0, *cuts.tolist()], [*cuts.tolist(), len(each)], strict=True)
            out.append((self.m.langs[best], float(min(max(mean[best], 0.0), 1.0)), [(a, b, self.m.langs[each[a]]) for a, b in runs]))
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1500, sample_chars: int = 4_000_000, **how) -> Model:
    """At most sample_rows rows with a language, those whose ids hash lowest, until sample_chars are reached."""
    usable = docs.select(F.col(id_col).alias("__id")).where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sample = sample_by_hash(usable, "__id", sample_rows).select("__id", F.xxhash64("__id").alias("o"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__t")).where(F.col("__lang").isNotNull() & F.col("__t").isNotNull())
    got, size = [], 0
    for r in rows.join(F.broadcast(sample), "__id").select("o", "__id", "__lang", "__t").distinct().toLocalIterator():
        got.append(tuple(r))
        size += len(got[-1][3])
        while size > sample_chars and len(got) > 1:
            got.sort()
            size -= len(got.pop()[3])
    got.sort()
    return train([x[3] for x in got], [x[2] for x in got], **how)


_LABELLERS: dict[str, Labeller] = {}


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_runs: bool = True) -> DataFrame:
    """id, lang_pred, score and, if asked for, runs (start, end, lang by word) of every row."""
    import pyarrow as pa

    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS weights a language, whatever the corpus
    key = uuid.uuid4().hex
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        if key not in _LABELLERS:
            _LABELLERS.clear()
            _LABELLERS[key] = Labeller(sent.value)
        labeller = _LABELLERS[key]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [x for a, b in chunks(texts) for x in labeller.label(texts[a:b])]
            out = [batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            names = [id_col, "lang_pred", "score"]
            if with_runs:
                out.append(pa.array([[{"start": a, "end": b, "lang": lang} for a, b, lang in x[2]] for x in got], run_type))
                names.append("runs")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double" + ", runs array<struct<start:int,end:int,lang:string>>" * with_runs
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
