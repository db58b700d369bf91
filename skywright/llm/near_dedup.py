"""Near duplicates by Order MinHash over occurrence-labelled word shingles, verified by banded alignment.

A text is its sequence of five-word shingles. A sketch takes the two smallest hashed shingles (labelled by their occurrence number) and
keeps them in text order; a band joins `rows` sketches. Texts that agree in a band are candidates. Similarity is that of an order-
preserving alignment: with L the length of the longest common subsequence of both shingle sequences of n and m,

    S = L / (n + m - L),   linked if S >= 0.8,

found with matches limited to the band of diagonals that any alignment good enough must stay in. 1 - S is a metric.

Equal word sequences are one node from the start. In each bucket of a band, every member is first compared with the bucket's pivots: its most
central members (those with most fellow members over all bands), one of each of `pivots` hash slots; members of one family reach each other
through its centre, in any of the bands. Then the members of buckets that still hold several components go through an exact prefix, length
and position filter on their shingles, which leaves the pairs that can be similar, whatever the bucket's size. So every two similar members of
a bucket are compared or in one class, and no bucket is cut. Classes are the connected components of the links.

Nodes are keyed by the digest of their words all the way, never by an id, since one id can stand on several texts; ids come in at the end.

Defined cases: a null text, or one without words, is a class of its own; a text of one to four words has one shingle, all its words;
rows that repeat id and text are one document, and rows of one id with different texts are different documents, each in the class of its text;
the class id is the smallest id in the class; a null id is in the class of its text and names a class only if the class has no other id; ties
between pivots go to the larger digest; very long texts are sketched whole, one at a time, and aligned in the band that the threshold leaves; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, materialize, prepare, release, without_ids
from .components import components, joined
from .decontam import normalise

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 3
PIVOTS = 3
#: Partners of a pivot in one block.
PARTNERS = 1000
#: Rows of a frequent shingle in one block.
BLOCK = 500
#: Counters of shingle frequencies, as a power of two.
COUNTER_BITS = 20
#: Ids sent to all executors to select texts; counted first, more are joined with a shuffle.
MOST_BROADCAST = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sketcher:
    """Sketches many texts at once; the hash of a word seen before comes from a bounded memo."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, memo_words: int = 400_000):
        self.bands, self.rows, self.words, self.memo_words = bands, rows, words, memo_words
        rng = np.random.default_rng(20)
        self.seeds = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)
        self.memo: dict[bytes, int] = {}

    def shingles(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(digest of each text's words, flat shingle hashes, number of shingles of each text)."""
        import xxhash

        memo, digest = self.memo, xxhash.xxh64_intdigest
        if len(memo) > self.memo_words:
            memo.clear()
        ids, flat, counts = [], [], []
        for t in texts:
            norm = normalise(t)
            ids.append(xxhash.xxh128_digest(norm) if norm else b"")
            ws = norm.split()
            for w in {w for w in ws if w not in memo}:
                memo[w] = digest(w)
            h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
            if len(h) > self.words:
                s = h[: len(h) - self.words + 1].copy()
                for k in range(1, self.words):
                    s = s * _ODD + h[k : len(h) - self.words + 1 + k]
            elif len(h):
                s = np.zeros(1, np.uint64)
                for x in h:
                    s = s * _ODD + x
            else:
                s = h
            flat.append(_mixed(s))
            counts.append(len(s))
        return ids, np.concatenate(flat) if flat else np.empty(0, np.uint64), np.array(counts, np.int64)

    def sketch(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(digests, numbers of shingles, band keys (texts, bands) as int64); keys of texts without words are 0."""
        ids, s, counts = self.shingles(texts)
        out = np.zeros((len(texts), self.bands), np.uint64)
        some = np.flatnonzero(counts)
        if len(some):
            n = counts[some]
            starts = np.cumsum(n) - n
            of = np.repeat(np.arange(len(some)), n)
            label = _labelled(s, of)
            single = n == 1
            for j, seed in enumerate(self.seeds):
                h = (label ^ seed) * _ODD
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                p1 = self._least(h, starts, n)
                h[p1] = _MAX
                p2 = np.where(single, p1, self._least(h, starts, n))
                a, b = np.minimum(p1, p2), np.maximum(p1, p2)
                key = _mixed(s[a] * np.uint64(3) + s[b] + seed)
                out[some, j // self.rows] = _mixed(out[some, j // self.rows] * _ODD + key + np.uint64(j))
        return ids, counts, out.view(np.int64)

    @staticmethod
    def _least(h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first place of each text's smallest value."""
        low = np.minimum.reduceat(h, starts)
        at = np.flatnonzero(h == np.repeat(low, n))
        return at[np.searchsorted(at, starts)]


def shingle_list(text: str | None, words: int = WORDS) -> list[tuple]:
    ws = normalise(text).split()
    return [tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))] if ws else []


def aligned(a: list, b: list, need: int) -> int:
    """Length of the longest common subsequence of a and b if it is `need` or more, else some smaller number.

    Bit-parallel over a's positions. Matches lie within the band that len(a) + len(b) - 2 * need insertions and deletions reach.
    """
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    e = 0
    while e < min(len(a), len(b)) - k and a[-1 - e] == b[-1 - e]:
        e += 1
    spare = len(a) + len(b) - 2 * need
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    if spare < 0 or not a or not b:
        return k + e
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    ones = (1 << len(a)) - 1
    v, band = ones, (1 << 2 * spare + 1) - 1
    narrow = 2 * spare + 1 < len(a)
    for j, x in enumerate(b):
        m = where.get(x)
        if m is None:
            continue
        if narrow:
            m &= band << j - spare if j >= spare else band >> spare - j
        u = v & m
        v = (v + u) | (v - u)
    return k + e + len(a) - (v & ones).bit_count()


class Verifier:
    def __init__(self, similarity: float = SIMILARITY, words: int = WORDS):
        self.similarity, self.words, self.last = similarity, words, (None, None)

    def _of(self, text: str | None):
        s = shingle_list(text, self.words)
        return s, set(s)

    def similar(self, a: str | None, b: str | None) -> float:
        """S of both texts, or 0.0 if it is below the threshold."""
        if self.last[0] != a:
            self.last = (a, self._of(a))
        (x, xs), (y, ys) = self.last[1], self._of(b)
        n, m = len(x), len(y)
        if not n or not m:
            return 0.0
        need = math.ceil(self.similarity * (n + m) / (1 + self.similarity) - 1e-9)
        if min(n, m) < need or len(xs & ys) + min(n - len(xs), m - len(ys)) < need:
            return 0.0
        found = aligned(x, y, need)
        return found / (n + m - found) if found >= need else 0.0


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node (digest of the words), n (shingles), keys."""
    import pyarrow as pa

    prepare(docs.sparkSession)

    def run(batches):
        s = Sketcher()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, n, keys = s.sketch(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(np.arange(0, (b - a) * s.bands + 1, s.bands, dtype=np.int32), pa.array(keys.ravel()))], ["id", "node", "n", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, node binary, n bigint, keys array<bigint>")


def with_nodes(rows: DataFrame, id_col: str, text_col: str, name: str = "node") -> DataFrame:
    """rows with the digest of their text's words (empty without words), as sketches() gives it."""
    import pyarrow as pa
    import xxhash

    prepare(rows.sparkSession)
    names = rows.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            norm = (normalise(t) for t in batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxhash.xxh128_digest(t) if t else b"" for t in norm], pa.binary())], [*names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())]))


def texts_of(nodes: DataFrame, docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and text of the given nodes (a column); firsts: node and one of its ids.

    The ids select the rows to read, and the rows' digests tell which of an id's texts is meant.
    """
    need = materialize(nodes.distinct().join(firsts, "node"), "near-need")
    n = need.count()
    few = F.broadcast(need) if n <= MOST_BROADCAST else need
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = with_nodes(rows.join(few.select(F.col("id").alias("i")), F.col("id").eqNullSafe(F.col("i")), "left_semi"), "id", "text")
    texts = materialize(rows.select("node", "text").join(few.select("node"), "node", "left_semi"), "near-texts")
    if texts.count() == n:
        return texts
    once = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "near-texts")  # repeated rows
    release(texts)
    return once


def candidates(reps: DataFrame, pivots: int = PIVOTS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes to compare, from reps (rep: a node, n, keys): every member of a bucket with the bucket's pivots; and the members (key, rep, n, count) of all buckets."""
    bands = reps.select("rep", "n", F.explode("keys").alias("key"))
    sizes = materialize(bands.groupBy("key").count().where("count > 1"), "near-buckets")
    live = materialize(bands.join(sizes, "key"), "near-members")
    central = materialize(live.groupBy("rep").agg(F.sum("count").alias("c")), "near-central")
    ranked = live.join(central, "rep").select("key", F.struct("c", "rep", "n").alias("m"), F.pmod(F.xxhash64("rep"), F.lit(pivots)).alias("slot"))
    best = ranked.groupBy("key").agg(*[F.max(F.when(F.col("slot") == k, F.col("m"))).alias(f"p{k}") for k in range(pivots)])
    best = materialize(best.select("key", F.array_compact(F.array(*[f"p{k}" for k in range(pivots)])).alias("pivots")), "near-pivots")
    pairs = live.select("key", "rep", "n").join(best, "key").select("rep", "n", F.explode("pivots").alias("p"))
    pairs = pairs.where((F.col("rep") != F.col("p.rep")) & (F.least("n", "p.n") >= similarity * F.greatest("n", "p.n") - 1e-9))
    return pairs.select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct(), live


def _labelled(s: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence number in their text mixed in, so that a text's multiset is a set; of: text of each shingle."""
    order = np.lexsort((np.arange(len(s)), s, of))
    same = np.append(False, (s[order][1:] == s[order][:-1]) & (of[order][1:] == of[order][:-1]))
    run = np.arange(len(s)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
    label = s.copy()
    label[order] += run.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return label


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def rest(live: DataFrame, labels: DataFrame, done: DataFrame, docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) to compare, of different components, among the members of buckets (live) with several; without those done.

    labels: node, label of the linked members. An exact set-similarity join takes the place of all pairs of a bucket: a text's shingles are
    put in one order, rare ones first, and texts as similar as asked for share one of their first n - ceil(similarity * n) + 1. A
    shingle's rows go where no partner is short enough for its position, and the others are paired by length and position. Frequencies
    are counted in a fixed number of counters by hash: a collision changes the order, which is right in any case, and not the result.
    """
    import pyarrow as pa

    prepare(docs.sparkSession)
    spark = docs.sparkSession
    kind = live.schema["rep"].dataType.simpleString()
    found = labels.select(F.col("node").alias("rep"), "label")
    # The two members of a bucket of two have been compared.
    bands = live.where("count > 2").join(found, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"), "key")
    mixed = bands.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    members = materialize(bands.join(mixed, "key", "left_semi").select(F.col("rep").alias("id"), "label").distinct(), "near-mixed")
    n = members.count()
    if not n:
        return done.select("a", "b").limit(0)
    few = F.broadcast(members) if n <= MOST_BROADCAST else members
    texts = texts_of(members.select(F.col("id").alias("node")), docs, firsts, id_col, text_col)
    texts = texts.select(F.col("node").alias("id"), "text").join(few, "id").select("id", "label", "text")

    def tokens(batch, s: Sketcher):
        texts = batch.column(2).to_pylist()
        for x, y in chunks(texts):
            _, flat, count = s.shingles(texts[x:y])
            of = np.repeat(np.arange(y - x), count)
            yield x, y, _labelled(flat, of), of, count

    def counted(batches):
        s, total = Sketcher(), np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for _, _, t, _, _ in tokens(batch, s):
                np.add.at(total, _place(t), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "n"])

    sums = texts.mapInArrow(counted, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # 2 ** COUNTER_BITS rows at most
    counters = np.zeros(1 << COUNTER_BITS, np.int64)
    counters[sums.column("place").to_numpy()] = sums.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(counters)

    def prefixes(batches):
        s, counters = Sketcher(), sent.value
        for batch in batches:
            for x, y, t, of, count in tokens(batch, s):
                frequency = counters[_place(t)]
                order = np.lexsort((t, frequency, of))
                t, frequency = t[order], frequency[order]
                pos = np.arange(len(t)) - np.repeat(np.cumsum(count) - count, count)
                n = np.repeat(count, count)
                keep = (pos <= n - np.ceil(similarity * n - 1e-9)) & (frequency > 1)
                rows = pa.array(of[keep] + x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(n[keep]), pa.array(t[keep].view(np.int64)), pa.array(pos[keep])], ["id", "label", "n", "token", "pos"])

    rows = texts.mapInArrow(prefixes, f"id {kind}, label {kind}, n bigint, token bigint, pos bigint")
    # A partner of m shingles needs (n + m) * similarity / (1 + similarity) common ones, and n - pos are left from here.
    longest = (F.col("n") - F.col("pos")) * ((1 + similarity) / similarity) - F.col("n") + 1e-6
    rows = materialize(rows.select("*", longest.alias("longest")), "near-prefixes")
    for _ in range(2):  # the second time with the partners that the first has left
        some = rows.groupBy("token").agg(F.count("*").alias("count"), F.min("n").alias("shortest"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        rows = rows.select("id", "label", "n", "token", "pos", "longest").join(some.select("token", "count", "shortest"), "token").where("shortest <= longest")
        rows = materialize(rows, "near-prefixes")
    # A frequent shingle's rows are dealt in blocks, and every two blocks meet in a task of their own.
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "label", "n", "pos", "longest")

    def paired(batches):
        import pyarrow.compute as pc

        left = None
        for batch in [*batches, None]:  # rows come sorted; the last group of a batch waits for the next batch
            if batch is not None:
                left = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if left is None or not left.num_rows:
                continue
            left = left.combine_chunks()
            token, x, y = (left.column(c).to_numpy() for c in ("token", "x", "y"))
            starts = np.append(np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))), len(token))
            if batch is not None:
                starts = starts[:-1]
            block, n, pos, longest = (left.column(c).to_numpy() for c in ("block", "n", "pos", "longest"))
            label = pc.dictionary_encode(left.column("label")).combine_chunks().indices.to_numpy()
            first, second = [], []
            for u, v in zip(starts[:-1], starts[1:], strict=True):
                side = np.arange(u, v)
                p = side if x[u] == y[u] else side[block[u:v] == x[u]]
                q = side if x[u] == y[u] else side[block[u:v] == y[u]]
                fits = (label[p][:, None] != label[q]) & (n[q] <= longest[p][:, None]) & (n[p][:, None] <= longest[q])
                i, j = np.nonzero(np.triu(fits) if x[u] == y[u] else fits)
                first.append(p[i])
                second.append(q[j])
            if first:
                ids = left.column("id").combine_chunks()
                a, b = (ids.take(pa.array(np.concatenate(k))) for k in (first, second))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])
            left = left.slice(starts[-1])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.repartition(parts, "token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(paired, f"a {kind}, b {kind}")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, with their similarity."""
    import pyarrow as pa

    texts = texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), docs, firsts, id_col, text_col)
    # A pivot with very many partners has them in blocks, each with a copy of its text.
    crowded = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("blocks")).where("blocks > 1"), "near-crowded")
    few = F.broadcast(crowded) if crowded.count() <= MOST_BROADCAST else crowded
    blocks = F.coalesce("blocks", F.lit(1))
    pairs = pairs.join(few, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).join(few, "a", "left").select("a", "ta", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(left, ["a", "block"])

    def run(batches):
        v = Verifier(similarity)
        for batch in batches:
            s = [v.similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, similarity double").where("similarity > 0")


def _classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node, n (shingles), label (a node of the class) and first (id and node of its first member; null without words) of every row."""
    sk = materialize(sketches(docs, id_col, text_col), "near-sketches")
    reps = sk.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.first("keys").alias("keys"))
    reps = materialize(reps, "near-reps")
    firsts = reps.select("node", "id")
    pairs, live = candidates(reps.select(F.col("node").alias("rep"), "n", "keys"))
    pairs = materialize(pairs, "near-pairs")
    links = materialize(verified(pairs, docs, firsts, id_col, text_col), "near-links")
    labels = components(links)
    more = materialize(rest(live, labels, pairs, docs, firsts, id_col, text_col), "near-rest")
    if not more.isEmpty():
        labels = materialize(joined(labels, materialize(verified(more, docs, firsts, id_col, text_col), "near-more-links")), "near-labels")
    of = materialize(firsts.join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label")), "near-labelled")
    named = of.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"))
    of = materialize(of.join(named, "label").select("node", "label", "first"), "near-classes")
    return sk.select("id", "node", "n").join(of, "node", "left")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (the smallest id of the class) and n_shingles of every row."""
    return _classed(docs, id_col, text_col).select(F.col("id").alias(id_col), F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.col("n").alias("n_shingles"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the smallest id. Rows without words are classes of their own and stay.

    Where an id stands on one row alone, the id decides. Rows that share an id are told apart by the digests of their words; of rows with
    one id and the same words that with the smallest text stays, of repeated rows one.
    """
    names = docs.columns
    own, node, text = fresh("id", names), fresh("node", names), fresh("text", names)
    found = materialize(_classed(docs, id_col, text_col), "near-found")
    wins = F.col("first").isNull() | ((F.col("first.node") == F.col("node")) & F.col("first.id").eqNullSafe(F.col("id")))
    kept = found.select("id", "node", (F.col("n") > 0).alias("has"), wins.alias("wins"))
    several = materialize(kept.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias(own)), "near-several")
    lone = kept.where(~F.col("wins")).select("id").where(F.col("id").isNotNull())
    out = without_ids(docs, lone if several.isEmpty() else lone.join(several, lone["id"] == several[own], "left_anti"), id_col)
    if several.isEmpty():
        return out
    rows = docs.join(several, docs[id_col].eqNullSafe(several[own]), "left_semi").withColumn(own, F.col(f"`{id_col}`")).withColumn(text, F.col(f"`{text_col}`").cast("string"))
    rows = materialize(with_nodes(rows, own, text, node), "near-several-rows")
    of, digest = fresh("of", [*names, own, text, node]), fresh("digest", [*names, own, text, node])
    best = kept.where("has and wins").select(F.col("id").alias(of), F.col("node").alias(digest)).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    blank = rows.where(F.octet_length(node) == 0).groupBy(own, text).agg(F.first(row).alias("row"))
    rows = rows.join(best, F.col(own).eqNullSafe(F.col(of)) & (F.col(node) == F.col(digest)), "left_semi")
    rows = rows.groupBy(own, node).agg(F.min_by(row, text).alias("row"))
    columns = [F.col(f"`{c}`") for c in names]
    others = out.join(several, out[id_col].eqNullSafe(several[own]), "left_anti")
    return others.select(*columns).unionByName(rows.select("row.*")).unionByName(blank.select("row.*"))
