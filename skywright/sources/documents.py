"""One large annotation document, read by byte ranges in many tasks.

A JSON document has no place where a reader may start: whether a byte stands in a string, and how deep, hangs on all bytes before. So every range is
lexed for each state it can be entered in (outside a string, inside, inside behind a backslash): quotes that no odd run of backslashes precedes change the
state, and brackets outside of strings the depth; prefix sums do both for all bytes at once. The ranges' small summaries, put together in order, give
each range its true state and depth. A second pass cuts out the objects at depth two, the entries of the top-level lists, in the range where they
begin, reading on behind its end for the last one; Spark's JSON reader then parses them by the list they are in.

Defined cases: entries are in the order of their place in the document (`pos`); lists of other names are left out; a list that is missing is an empty table;
keys inside entries may be named as lists are; an entry that is no valid JSON is an error; several files are a document each, and their
places follow each other by file name. With `parts` all files below a folder, by their names, are the parts of one document, cut at any byte; their
names are listed on the driver.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywright.sources import files, schemas
from skywright.sources.sinks import place_of
from skywright.sources.storage import written

RANGE = 4 << 20
#: Bytes of a document that one task reads (or one range).
TASK_BYTES = 16 << 20
#: Rows of one file of a written document.
ROWS_A_FILE = 200_000
#: Top-level keys of a document; they are gathered on the driver.
MOST_KEYS = 10_000

_OUTSIDE, _INSIDE, _ESCAPED = 0, 1, 2
_CHANGE = np.array([(c in b"{[") - (c in b"}]") for c in range(256)], np.int8)


def lexed(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(quotes that open or close strings, for every byte if it stands inside a string, end state) of a range entered in `state`."""
    slashes = np.flatnonzero(data == 0x5C)
    first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
    run = np.diff(first, append=len(slashes))
    behind = slashes[first] + run  # for each run of backslashes the place behind it
    if state == _ESCAPED and len(behind) and slashes[0] == 0:
        run[0] += 1
    elif state == _ESCAPED:
        behind, run = np.append(0, behind), np.append(1, run)
    escaped = behind[run % 2 == 1]
    quote = data == 0x22
    quote[escaped[escaped < len(data)]] = False
    passed = np.logical_xor.accumulate(quote) ^ (state != _OUTSIDE)
    last = passed[-1] if len(data) else state != _OUTSIDE
    end = _OUTSIDE if not last else _ESCAPED if len(escaped) and escaped[-1] == len(data) else _INSIDE
    return quote, passed ^ quote, end


def depths(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Change of depth at every byte."""
    return _CHANGE[data] * ~inside


def _starts(summaries: list[tuple]) -> list[tuple[int, int]]:
    """(state, depth) before each range; summaries: for each entry state the end state and the change of depth."""
    out, state, depth = [], _OUTSIDE, 0
    for s in summaries:
        out.append((state, depth))
        state, depth = s[2 * state], depth + s[2 * state + 1]
    return out


def entries(data: np.ndarray, size: int, state: int, depth: int) -> tuple[list[tuple[int, str, bytes]], bool]:
    """(place, kind, bytes) of the keys at depth one and the entries at depth two that begin in the first `size` bytes; and if any goes on behind data."""
    quote, inside, _ = lexed(data, state)
    change = depths(data, inside)
    at = np.flatnonzero(quote | (change != 0))  # quotes and brackets; all else is done for these alone
    byte, inside, change = data[at], inside[at], change[at]
    before = depth + np.cumsum(change) - change
    begin, end = at[(byte == 0x7B) & (before == 2)], at[(byte == 0x7D) & (before == 3)]
    begin = begin[begin < size]
    k = np.searchsorted(end, begin)
    open_, whole = bool((k == len(end)).any()), k < len(end)
    text = data.tobytes()
    out = [(b, "entry", text[b : e + 1]) for b, e in zip(begin[whole].tolist(), end[k[whole]].tolist(), strict=True)]
    strings, closing = at[(byte == 0x22) & ~inside & (before == 1)], at[(byte == 0x22) & inside]
    for b in strings[strings < size]:
        k = np.searchsorted(closing, b)
        rest = data[closing[k] + 1 : closing[k] + 65].tobytes().lstrip() if k < len(closing) else b""
        if not rest:
            open_ = True
        elif rest[:1] == b":":
            out.append((int(b), "key", data[b : closing[k] + 1].tobytes()))
    return out, open_


class _Joined:
    """Files one after the other, read as one; pieces: (path, place of its first byte, length)."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces, self.starts, self.at = pieces, [start for _, start, _ in pieces], 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, size: int) -> bytes:
        out, k = [], bisect_right(self.starts, self.at) - 1
        while size and k < len(self.pieces):
            path, start, length = self.pieces[k]
            if n := min(size, start + length - self.at):
                place, at = place_of(path)
                with place.open_input_file(at) as f:
                    f.seek(self.at - start)
                    out.append(f.read(n))
                self.at, size = self.at + n, size - n
            k += 1
        return b"".join(out)


@contextmanager
def _opened(path: str, pieces: list[tuple[str, int, int]] | None):
    if pieces is not None:
        yield _Joined(pieces)
        return
    place, at = place_of(path)
    with place.open_input_file(at) as f:
        yield f


def _pieces(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    out, start = [], 0
    for r in sorted(files.listing(spark, path, recursive=True).collect()):
        out.append((r["path"], start, r["length"]))
        start += r["length"]
    return out


def _ranges(spark: SparkSession, path: str, size: int, pieces: list[tuple[str, int, int]] | None) -> DataFrame:
    if pieces is None:
        found = files.listing(spark, path)
    else:
        found = spark.createDataFrame([(path, sum(n for *_, n in pieces))] if pieces else [], "path string, length bigint")
    return found.select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("k"))


def _tasks(ranges: DataFrame, size: int) -> int:
    """Number of tasks that ranges are dealt to, by their bytes. Their rows are small whatever they stand for, so without a number adaptive
    execution would put them all into one task."""
    n, total = ranges.agg(F.count("*"), F.sum(F.least(F.lit(size), F.col("length") - F.col("k") * size))).first()
    return max(1, min(n, max(2 * ranges.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // TASK_BYTES))))


def annotation_tables(spark: SparkSession, path: str, size: int = RANGE, parts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images (with `pos`), annotations and categories of a document of any size."""
    import pyarrow as pa

    pieces = _pieces(spark, path) if parts else None

    def summed(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for p, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with _opened(p, pieces) as f:
                    f.seek(k * size)
                    data = np.frombuffer(f.read(size), np.uint8)
                row = []
                for state in (_OUTSIDE, _INSIDE, _ESCAPED):
                    _, inside, end = lexed(data, state)
                    row += [end, int(depths(data, inside).sum())]
                rows.append(row)
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "e0", "d0", "e1", "d1", "e2", "d2"])

    def resolved(table):
        table = table.sort_by("k")
        starts = _starts(list(zip(*(table.column(c).to_pylist() for c in ("e0", "d0", "e1", "d1", "e2", "d2")), strict=True)))
        return table.select(["path", "length", "k"]).append_column("state", pa.array([s for s, _ in starts], pa.int64())).append_column("depth", pa.array([d for _, d in starts], pa.int64()))

    def cut(batches: Iterator) -> Iterator:
        for batch in batches:
            for p, length, k, state, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(p, pieces) as f:
                    f.seek(k * size)
                    data, more = f.read(size), True
                    own = len(data)
                    data += f.read(256)  # enough for a key that is cut
                    while more:
                        found, more = entries(np.frombuffer(data, np.uint8), own, state, depth)
                        more = more and bool(block := f.read(max(size, len(data))))
                        data += block if more else b""
                place_, kind, text = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(found), pa.string()), pa.array([k * size + i for i in place_], pa.int64()), pa.array(kind, pa.string()), pa.array([t.decode() for t in text], pa.string())], ["path", "place", "kind", "value"])

    ranges = _ranges(spark, path, size, pieces)
    numbers = "e0 bigint, d0 bigint, e1 bigint, d1 bigint, e2 bigint, d2 bigint"
    n = _tasks(ranges, size)
    sums = ranges.repartition(n).mapInArrow(summed, f"path string, length bigint, k bigint, {numbers}")
    # A row for each range of a document.
    starts = written(sums.groupBy("path").applyInArrow(resolved, "path string, length bigint, k bigint, state bigint, depth bigint"), "document-ranges")
    rows = written(starts.repartition(n).mapInArrow(cut, "path string, place bigint, kind string, value string"), "document-entries")
    keys = rows.where("kind = 'key'").select("path", "place", "value").limit(MOST_KEYS + 1).collect()
    if len(keys) > MOST_KEYS:
        raise ValueError(f"the document has over {MOST_KEYS} top-level keys")
    kinds = {f.name: f.dataType.elementType for f in T.StructType.fromDDL(schemas.COCO).fields}
    section = F.lit(None).cast("string")
    for k in sorted(keys, key=lambda k: (k["path"], k["place"])):
        section = F.when((F.col("path") == k["path"]) & (F.col("place") > k["place"]), F.lit(json.loads(k["value"]))).otherwise(section)
    named = rows.where("kind = 'entry'").withColumn("section", section)
    first = sorted({k["path"] for k in keys})
    file = F.coalesce(*[F.when(F.col("path") == p, F.lit(i)) for i, p in enumerate(first)], F.lit(0)).cast("bigint")
    pos = F.shiftleft(file, 48) + F.col("place")
    # The optimizer may move later filters below a filter, and a copy of the parser for each of their columns; not below a number of rows.
    parsed = lambda name: F.when(F.monotonically_increasing_id() >= 0, F.from_json("value", kinds[name], {"mode": "FAILFAST"}))
    part = lambda name: named.where(F.col("section") == name).select(pos.alias("pos"), parsed(name).alias("x")).select("pos", "x.*")
    return part("images"), part("annotations").drop("pos"), part("categories").drop("pos")


def write_document(lists: dict[str, DataFrame], path: str, rows_a_file: int = ROWS_A_FILE) -> None:
    """One JSON object with a list for each table, cut into files: put together in the order of their names they are the document
    (annotation_tables with `parts` reads it so). A list's rows are in the order of their text; every file is sorted and written by a task of its own."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def line(spark: SparkSession, text: str, place: int) -> None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{place:04d}")

    def separated(low: str):
        def run(batches: Iterator) -> Iterator:
            """A comma before every row but the first one of all: equal rows are in one range, and the lowest one begins its range."""
            first = True
            for batch in batches:
                column = batch.column(0)
                out = pc.binary_join_element_wise(",", column, "")
                if first and len(column):
                    first = False
                    if column[0].as_py() == low:
                        out = pa.concat_arrays([column.slice(0, 1).cast(out.type), out.slice(1)])
                yield pa.RecordBatch.from_arrays([out], ["value"])

        return run

    for i, (name, rows) in enumerate(lists.items()):
        line(rows.sparkSession, f'{"{" if i == 0 else "],"}{json.dumps(name)}: [', 2 * i)
        text = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
        n, low = text.agg(F.count("*"), F.min("value")).first()
        if n:
            dealt = text.repartitionByRange(-(-n // rows_a_file), "value").sortWithinPartitions("value")
            dealt.mapInArrow(separated(low), "value string").write.text(f"{path}/{2 * i + 1:04d}")
    line(rows.sparkSession, "]}", 2 * len(lists))
