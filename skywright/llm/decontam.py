"""Benchmark decontamination with one Aho-Corasick automaton over all windows of the benchmark's items.

Texts are normalised to their words (A-Z lower-cased) with one blank around each, and every window of an item becomes the
pattern " w1 ... w10 ". The automaton reads a normalised text once; the end of each occurrence maps back to word numbers, and
those to code points of the original text. The automaton travels to the executors as the list of its patterns, whose total length
is measured first: a benchmark above `block_chars` is cut by hash into blocks of items with one automaton and one scan each, one after
the other, whose findings are merged by document.

Defined cases: a null text or a text without words has no words and is never contaminated; an item without words has no window;
an item with fewer words than a window is one window of all its words; items that repeat id and text are one, a null item id counts as an empty
one; repeated rows of documents give repeated results; very long texts are read whole; an empty benchmark contaminates nothing, and empty
documents give no rows; other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Total code points of the windows in one automaton; about 100 bytes of a worker's memory each.
BLOCK_CHARS = 2_000_000
_BYTE = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def normalise(text: str | None) -> bytes:
    """b" w1 w2 ... wn ", or b"" without words. Bytes above 0x7F belong to words and stay as they are."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_BYTE).split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(text: str | None, size: int = 10) -> set[str]:
    words = normalise(text).decode("utf-8", "surrogatepass").split(" ")[1:-1]
    return {" " + " ".join(words[i : i + size]) + " " for i in range(max(1, len(words) - size + 1))} if words else set()


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of half-open ranges of its words."""
    at = [m.span() for m in re.finditer("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


class Automaton:
    """patterns: window -> numbers of the items that hold it."""

    def __init__(self, patterns: dict[str, list[int]]):
        import ahocorasick

        self.a = ahocorasick.Automaton()
        for window, items in patterns.items():
            self.a.add_word(window, (window.count(" ") - 1, items))
        self.empty = not patterns
        if patterns:
            self.a.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(words of the text, merged word ranges that are hit, item numbers)."""
        data = normalise(text)
        n = data.count(b" ") - 1 if data else 0
        if not n or self.empty:
            return n, [], set()
        norm = data.decode("utf-8", "surrogatepass")
        found = list(self.a.iter(norm))
        if not found:
            return n, [], set()
        blanks = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32) == 32).tolist()
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for end, (size, of) in found:
            stop = bisect_left(blanks, end)
            items.update(of)
            start = stop - size
            if spans and start <= spans[-1][1]:
                low = start
                while spans and spans[-1][1] >= start:  # ends ascend, so only the last ranges can touch
                    low = min(low, spans.pop()[0])
                spans.append((low, stop))
            else:
                spans.append((start, stop))
        return n, spans, items


_BUILT: dict[str, Automaton] = {}


def _automaton(key: str, patterns: dict[str, list[int]]) -> Automaton:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(patterns)
    return _BUILT[key]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: id, n_words, spans (hit word ranges), char_spans (the same in code points of the text), items (ids as strings, sorted)."""
    import pyarrow as pa

    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = f"id {kind}, row_no bigint, n_words bigint, spans array<struct<start:int,end:int>>, char_spans array<struct<start:int,end:int>>, items array<string>"
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")).where(F.col("text") != "").distinct()
    total = bench.agg(F.coalesce(F.sum(F.length("text").cast("long") * size), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    source = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("row_no"), F.col(text_col).cast("string").alias("text"))
    if blocks > 1:  # a row's number tells rows that repeat an id apart; it is written, so that every block sees the same
        source = materialize(source.withColumn("row_no", F.monotonically_increasing_id()), "decontam-texts")
        bench = materialize(bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "decontam-items")

    def scanned(items: DataFrame, rows: DataFrame) -> DataFrame:
        """One scan with the automaton of some items, which the driver holds until it is sent."""
        patterns: dict[str, list[int]] = {}
        names: dict[str, int] = {}
        for item, text in items.select("item", "text").toLocalIterator():  # about block_chars, counted before
            n = names.setdefault("" if item is None else item, len(names))
            for w in windows(text, size):
                of = patterns.setdefault(w, [])
                if n not in of[-1:]:
                    of.append(n)
        listed = list(names)
        key = uuid.uuid4().hex
        sent = spark.sparkContext.broadcast((patterns, listed))

        def run(batches):
            patterns, listed = sent.value
            auto = _automaton(key, patterns)
            for batch in batches:
                n, s, c, i = [], [], [], []
                for text in batch.column(2).to_pylist():
                    words, spans, items = auto.scan(text)
                    n.append(words)
                    s.append([{"start": a, "end": b} for a, b in spans])
                    c.append([{"start": a, "end": b} for a, b in original_spans(text, spans)] if spans else [])
                    i.append(sorted({listed[x] for x in items}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s, pair), pa.array(c, pair), pa.array(i, pa.list_(pa.string()))], ["id", "row_no", "n_words", "spans", "char_spans", "items"])

        return rows.mapInArrow(run, schema)

    if blocks == 1:
        return scanned(bench, source).drop("row_no").withColumnRenamed("id", id_col)
    out = None
    for k in range(blocks):  # one block's patterns are on the driver at a time; its scan ends before the next one's are made
        part = materialize(scanned(bench.where(F.col("block") == k), source), f"decontam-block-{k}")
        out = part if out is None else out.unionByName(part)
    ranges = lambda c: F.aggregate(F.array_sort(F.flatten(F.collect_list(c))), F.array().cast("array<struct<start:int,end:int>>"), _join)
    found = out.groupBy("id", "row_no").agg(F.max("n_words").alias("n_words"), ranges("spans").alias("spans"), ranges("char_spans").alias("char_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.drop("row_no").withColumnRenamed("id", id_col)


def _join(done, x):
    """Adds range x to the ranges so far, which end before or touch it."""
    touching = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"])
    merged = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]).alias("end"))))
    return F.when(touching, merged).otherwise(F.concat(done, F.array(x)))


def n_hit(spans):
    return F.aggregate(F.transform(spans, lambda x: (x["end"] - x["start"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of query op5 from decontaminate()'s."""
    hit = n_hit(F.col("spans"))
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
