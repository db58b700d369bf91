"""Repeated passages by a distributed sparse suffix array.

Suffixes are retained where a text's content selects them: at the least hashed k-gram of every `min_words` words, so any passage of that
length keeps a suffix at the same place in all its copies. Suffixes are dealt by their k-gram, and each stands for the windows of `min_words`
words that select it: its text from up to `min_words` - k words before the k-gram on. In its partition the suffixes are sorted in every such
placement (by the hash of the window's words), so that those that agree are neighbours; neighbours of different documents match, and
matches in placements that follow each other are extended to the left and to the right into one passage.

So a window is found if and only if another document holds it: no number of other texts with the same k-gram comes between. Windows are
compared by two 64-bit hashes, of the k-gram and of all the words. The suffixes of a very frequent k-gram are salted: each salt settles what
it can, and what is left meets by its windows (see matches()).

Equal word sequences are one text from the start, keyed by the digest of its words: its documents repeat each other as a whole. All
comparisons are of texts; ids come in at the end, so an id on several texts mixes nothing up.

Defined cases: a null text, or one of fewer words, has no passage; repeats inside one document alone do not count; rows that repeat id and
text are one document, and rows of one id with different texts are different documents; a null id is a document's like any other; overlapping or touching passages of a document are one span; documents without passages are not in the result; very
long texts are read whole, one at a time, and their suffixes are dealt like others; of several partners with a window one is named, by the
smallest id of its text (null if it has no other); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, prepare, release
from .decontam import _join, normalise
from .near_dedup import MOST_BROADCAST, _mixed, texts_of

MIN_WORDS = 50
K = 16
_P = np.uint64(0x9E3779B97F4A7C15)
#: Windows a partition holds, about; each takes some 100 bytes in its task.
WINDOWS = 150_000


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 1 << 64))


#: Suffixes of one k-gram in one salt.
HOT = 2000


def selected(h: np.ndarray, min_words: int = MIN_WORDS, k: int = K, windows: bool = True) -> tuple[np.ndarray, ...]:
    """(first windows, k-gram hashes, numbers of windows) of a text's retained suffixes, and the hashes of all windows, if asked for; h: word hashes."""
    n = len(h)
    if n < min_words:
        return np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = {1: h}
    while 2 * max(sums) <= min_words:
        m = max(sums)
        sums[2 * m] = sums[m][:-m] * _power(m) + sums[m][m:]

    def runs(length: int) -> np.ndarray:
        """Hashes of `length` words from every place on."""
        count, at = n - length + 1, 0
        out = np.zeros(count, np.uint64)
        for m in sorted(sums, reverse=True):
            while length - at >= m:
                out, at = out * _power(m) + sums[m][at : at + count], at + m
        return _mixed(out)

    own = runs(k)
    least = np.lib.stride_tricks.sliding_window_view(own, min_words - k + 1).argmin(1)
    at = least + np.arange(len(least))
    first = np.flatnonzero(_runs([at]))
    return first.astype(np.int32), own[at[first]], np.diff(np.append(first, len(at))), runs(min_words) if windows else np.empty(0, np.uint64)


def suffixes(docs: DataFrame, id_col: str, text_col: str, min_words: int, windows: bool) -> DataFrame:
    """id, node (digest of the words), n_words and the retained suffixes of every row: first window, k-gram, and with `windows` 8 bytes of hash for each window."""
    import pyarrow as pa
    import xxhash

    prepare(docs.sparkSession)

    def run(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                if len(memo) > 400_000:
                    memo.clear()
                ids, n, cuts, cols = [], [], [0], []
                for t in texts[a:b]:
                    norm = normalise(t)
                    ws = norm.split()
                    for x in {x for x in ws if x not in memo}:
                        memo[x] = xxhash.xxh64_intdigest(x) | 1
                    ids.append(xxhash.xxh128_digest(norm))
                    n.append(len(ws))
                    cols.append(selected(np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws)), min_words, windows=windows))
                    cuts.append(cuts[-1] + len(cols[-1][0]))
                first, h, count, hashes = (np.concatenate(x) for x in zip(*cols, strict=True))
                flat = [pa.array(first), pa.array(h.view(np.int64)), *([_packed(hashes, count)] if windows else [])]
                flat = pa.StructArray.from_arrays(flat, ["first", "h", "windows"][: len(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(np.array(cuts, np.int32), flat)], ["id", "node", "n_words", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, node binary, n_words bigint, kept array<struct<first:int,h:bigint{',windows:binary' if windows else ''}>>")


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new run of equal keys begins, of sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _packed(windows: np.ndarray, count: np.ndarray):
    """Binary array with the next `count` hashes in each value."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(count) * 8]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(windows))])


def _unpacked(packed) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of them in each value) of a binary array."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, np.int32)
    data = packed.buffers()[2]
    windows = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint64) if data is not None else np.empty(0, np.uint64)
    return windows, np.diff(offsets) // 8


def several(keys: list[np.ndarray], order: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row if a row of another document has its keys, and the smallest such document (for the smallest one the largest); `order` sorts by keys."""
    if not len(order):
        return np.empty(0, bool), np.empty(0, doc.dtype)
    d, new = doc[order], _runs([k[order] for k in keys])
    which, first = np.cumsum(new) - 1, np.flatnonzero(new)
    low, high = np.minimum.reduceat(d, first)[which], np.maximum.reduceat(d, first)[which]
    ok, other = np.empty(len(d), bool), np.empty(len(d), doc.dtype)
    ok[order], other[order] = low != high, np.where(d == low, high, low)
    return ok, other


def _places(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, place in its text) of every window of suffixes with `count` windows each from `first` on."""
    of = np.repeat(np.arange(len(first)), count)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def runs_of(doc: np.ndarray, other: np.ndarray, place: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(documents, other documents, starts, ends): repeated windows that follow each other, extended to the left and to the right as far as they go."""
    begin = np.flatnonzero(_runs([doc, other, place - np.arange(len(place))]))
    last = np.append(begin[1:], len(place)) - 1 if len(place) else begin
    return doc[begin], other[begin], place[begin], place[last] + min_words


def repeated(h: np.ndarray, doc: np.ndarray, first: np.ndarray, packed, min_words: int, salts: np.ndarray | None = None) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(runs of repeated windows, windows to compare elsewhere) of the suffixes of a partition.

    Of a k-gram in one salt all rows are here. Of others, the windows that one document here holds go on (suffix, place, window,
    False), and one of those that several hold, to stand for them (suffix, place, window, True).
    """
    import pyarrow as pa

    salts = np.ones(len(h), np.int64) if salts is None else salts
    some, _ = several([h], np.argsort(h), doc)
    some |= salts > 1
    windows, count = _unpacked(packed.filter(pa.array(some)))
    at = np.flatnonzero(some)
    of, place = _places(first[at], count)
    of = at[of]
    order = np.argsort(windows)
    ok, other = several([windows, h[of]], order, doc[of])
    runs = runs_of(doc[of[ok]], other[ok], place[ok], min_words)
    wide = salts[of] > 1
    head = np.zeros(len(of), bool)
    if wide.any():
        head[order[_runs([windows[order], h[of][order]])]] = True
    go = wide & (~ok | head)
    return runs, (of[go], place[go], windows[go], ok[go])


def matches(kept: DataFrame, shared: DataFrame, kind: str, count: int, min_words: int) -> DataFrame:
    """id, other, start, end of the repeated windows (runs of them), from rows of id, first, h, windows, `count` windows in all; shared: h and count of k-grams.

    Suffixes of one k-gram go to one partition, those of a very frequent one to several (salts). There a window that several documents
    hold is settled, and only one row stands for it when the windows left are dealt again, by what they hold. So a window in any number
    of documents makes a row for each salt at most.
    """
    import pyarrow as pa

    spark = kept.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = materialize(shared.where(F.col("count") > HOT).select("h", F.ceil(F.col("count") / HOT).cast("bigint").alias("salts")), "suffix-hot")
    n = hot.count()
    salted = kept.join(F.broadcast(hot) if n <= MOST_BROADCAST else hot, "h", "left").select("id", "first", "h", "windows", F.coalesce("salts", F.lit(1)).alias("salts"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))

    def loaded(batches):
        import pyarrow.compute as pc

        got = [b for b in batches if b.num_rows]
        if not got:
            return None
        t = pa.Table.from_batches(got).combine_chunks()
        coded = t.column("id").chunk(0).dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return t, rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))

    names = ["id", "other", "start", "end", "h", "salts", "part", "settled", "places", "windows"]

    def found(names_of, runs):
        doc, other, start, end = runs
        empty = [pa.nulls(len(doc), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([names_of.take(pa.array(doc)), names_of.take(pa.array(other)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), *empty], names)

    def near(batches):
        if (got := loaded(batches)) is None:
            return
        t, doc, ids = got
        h, first, salts = (t.column(c).to_numpy() for c in ("h", "first", "salts"))
        runs, (of, place, windows, settled) = repeated(h, doc, first, t.column("windows").chunk(0), min_words, salts)
        yield found(ids, runs)
        if not len(of):
            return
        part = (windows % salts[of].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((place, settled, part, of))
        of, place, windows, settled, part = of[order], place[order], windows[order], settled[order], part[order]
        begin = np.flatnonzero(_runs([of, part, settled]))
        size = np.diff(np.append(begin, len(of)))
        row = of[begin]
        places = pa.array([place[b : b + s].astype(np.int32).tobytes() for b, s in zip(begin, size, strict=True)], pa.binary())
        none = [pa.nulls(len(row), ids.type), pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.int32())]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[row])), *none, pa.array(h[row]), pa.array(salts[row]), pa.array(part[begin]), pa.array(settled[begin]), places, _packed(windows, size)], names)

    def far(batches):
        if (got := loaded(batches)) is None:
            return
        t, doc, ids = got
        windows, count = _unpacked(t.column("windows").chunk(0))
        place = np.concatenate([np.frombuffer(x, np.int32) for x in t.column("places").to_pylist()])
        of = np.repeat(np.arange(t.num_rows), count)
        ok, other = several([windows, t.column("h").to_numpy()[of]], np.argsort(windows), doc[of])
        ok &= ~t.column("settled").combine_chunks().to_numpy(zero_copy_only=False)[of]
        yield found(ids, runs_of(doc[of[ok]], other[ok], place[ok], min_words))

    schema = f"id {kind}, other {kind}, start int, end int, h bigint, salts bigint, part bigint, settled boolean, places binary, windows binary"
    parts = max(least, -(-count // WINDOWS))
    out = salted.repartition(parts, "h", "salt").select("id", "first", "h", "windows", "salts").mapInArrow(near, schema)
    if not n:
        return materialize(out.select("id", "other", "start", "end"), "suffix-matches")
    out = materialize(out, "suffix-matches")
    more = out.where(F.col("part").isNotNull()).repartition(parts, "h", "part").select("id", "h", "settled", "places", "windows").mapInArrow(far, schema)
    more = materialize(more.select("id", "other", "start", "end"), "suffix-far-matches")
    return out.where(F.col("part").isNull()).select("id", "other", "start", "end").unionByName(more)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, n_words, n_repeated, spans (word ranges) and partners (ids a passage was matched with) of every document with a passage."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = materialize(suffixes(docs, id_col, text_col, min_words, False), "suffixes")
    nodes = materialize(table.where(F.col("n_words") >= min_words).select("id", "node", "n_words").distinct(), "suffix-texts")
    one = F.struct(F.col("id").isNull().alias("none"), "id")
    firsts = materialize(nodes.groupBy("node").agg(F.min(one).alias("first"), F.max(one).alias("last"), F.count("*").alias("copies")), "suffix-nodes")
    # One document stands for each text; its suffixes are compared with those of other texts, by the digest of its words.
    copies = nodes.join(firsts.where("copies > 1"), "node").where(~F.col("id").eqNullSafe(F.col("first.id"))).select(F.col("id").alias("copy"), F.col("node").alias("of"))
    copies = materialize(copies, "suffix-copies")
    few = F.broadcast(copies) if copies.count() <= MOST_BROADCAST else copies
    kept = table.where(F.size("kept") > 0).join(few, F.col("id").eqNullSafe(F.col("copy")) & (F.col("node") == F.col("of")), "left_anti")
    slim = kept.select("node", F.explode("kept.h").alias("h"))
    shared = slim.groupBy("h").agg(F.count("*").alias("count"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    shared = materialize(shared.select("h", "count"), "suffix-shared")
    grams = F.broadcast(shared.select("h")) if shared.count() <= MOST_BROADCAST else shared.select("h")
    # Only the texts with a k-gram of another one are read again, for their windows.
    need = slim.join(grams, "h", "left_semi").select("node").distinct()
    texts = texts_of(need, docs, firsts.select("node", F.col("first.id").alias("id")), id_col, text_col)
    full = materialize(suffixes(texts, "node", "text", min_words, True).select(F.col("id").alias("node"), "n_words", "kept"), "suffix-full")
    release(table, texts)
    count = full.agg(F.coalesce(F.sum(F.greatest(F.col("n_words") - min_words + 1, F.lit(0))), F.lit(0))).first()[0]
    rows = matches(full.select(F.col("node").alias("id"), F.explode("kept").alias("s")).select("id", "s.*"), shared, "binary", count, min_words)
    release(full)
    spans = "array<struct<start:int,end:int>>"
    other = firsts.select(F.col("node").alias("other"), "first")
    rows = rows.select(F.col("id").alias("node"), "other", "start", "end").join(other, "other").select("node", F.col("first.id").alias("partner"), "start", "end")
    merged = F.aggregate(F.sort_array(F.collect_set(F.struct("start", "end"))), F.array().cast(spans), _join)
    # A text's matches: at most a few for each of its own suffixes.
    found = rows.groupBy("node").agg(merged.alias("spans"), F.collect_set("partner").alias("partners"))
    out = nodes.join(firsts, "node").join(found, "node", "left").where((F.col("copies") > 1) | F.col("spans").isNotNull())
    # A text that another document holds too is repeated as a whole.
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    copy = F.when(F.col("copies") > 1, F.array(F.when(F.col("first.id").eqNullSafe(F.col("id")), F.col("last.id")).otherwise(F.col("first.id")))).otherwise(F.array().cast(f"array<{kind}>"))
    partners = F.array_sort(F.array_distinct(F.concat(copy, F.coalesce("partners", F.array().cast(f"array<{kind}>")))))
    out = out.select("id", "n_words", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).cast(spans).alias("spans"), partners.alias("partners"))
    total = F.aggregate(F.transform("spans", lambda x: (x["end"] - x["start"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(F.col("id").alias(id_col), "n_words", total.alias("n_repeated"), "spans", "partners")
