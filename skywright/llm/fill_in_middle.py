"""Fill-in-middle transformation by a parallel automaton scan.

A token is a run of ASCII letters or one other code point. The automaton that cuts tokens has two states (outside, inside a run) and reads
UTF-8 bytes: a letter outside of a run and any other first byte begin a token. A chunk of text is summed up by a transition function (the
state it ends in, for each state it is entered in) and by the tokens that begin in it, for each of these states. Such summaries compose
associatively, so the entry state of every chunk, and the tokens before it, come from a parallel prefix composition; a cut is then looked
for in its own chunk only.

Texts of up to GIANT bytes are chunks of their own and cut where they are read, many at once. Larger ones are split into chunks that are dealt to
all tasks; their summaries meet by text (GIANT bytes are at least two chunks, a text of Spark's largest size makes about 65,000), and the chunks
that hold cuts are scanned again for the exact places.

Defined cases: a null text counts as empty and is plain; a null id is the text `null` in the draws; rows that repeat id and text get the same
result; very long texts are scanned in chunks, never in prefixes; an empty table gives no rows; other columns are kept as they are where asked
for, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_IDS, materialize, prepare

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and of these with the suffix first.
CUT_SHARE, SPM_SHARE = 90, 20
CHUNK = 32_768
GIANT = 2 * CHUNK

_LETTER = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)
_FIRST = np.array([not 0x80 <= b < 0xC0 for b in range(256)])


def begins(data: np.ndarray, starts: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which bytes begin a token; starts: first bytes of the (non-empty) chunks, entry: the states they are entered in."""
    letter = _LETTER[data]
    inside = np.append(False, letter[:-1])[: len(data)]
    inside[starts] = entry
    return np.where(letter, ~inside, _FIRST[data])


def summaries(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row for each chunk data[bounds[i]:bounds[i + 1]]: end state and number of tokens if entered outside, the same if entered inside, code points."""
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), 5), np.int64)
    out[:, 2] = 1  # an empty chunk leaves the state as it is
    if len(some):
        at = bounds[some]
        tokens = np.add.reduceat(begins(data, at, np.zeros(len(at), bool)).astype(np.int64), at)
        points = np.add.reduceat(_FIRST[data].astype(np.int64), at)
        first, last = _LETTER[data[at]], _LETTER[data[bounds[some + 1] - 1]]
        out[some] = np.stack([last, tokens, last, tokens - first, points], 1)
    return out


def composed(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Row by row the summary of f's chunk followed by g's."""
    out = np.empty_like(f)
    for state in (0, 2):
        middle = f[:, state] == 1
        out[:, state] = np.where(middle, g[:, 2], g[:, 0])
        out[:, state + 1] = f[:, state + 1] + np.where(middle, g[:, 3], g[:, 1])
    out[:, 4] = f[:, 4] + g[:, 4]
    return out


def scanned(rows: np.ndarray) -> np.ndarray:
    """Summaries of all prefixes of a text's chunks, by doubling."""
    rows, step = rows.copy(), 1
    while step < len(rows):
        rows[step:] = composed(rows[:-step], rows[step:])
        step *= 2
    return rows


def place(data: np.ndarray, inside: bool, token: int) -> int:
    """Code points of a chunk before its token number `token` (from 0)."""
    at = np.flatnonzero(begins(data, np.zeros(1, np.int64), np.array([inside])))[token]
    return int(_FIRST[data[:at]].sum())


def cuts(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, code points before the first cut, before the second) of texts that are a chunk each."""
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    begin = begins(data, bounds[some], np.zeros(len(some), bool)) if len(some) else np.empty(0, bool)
    at = np.append(np.flatnonzero(begin), 0)
    before = np.append(0, np.cumsum(begin))[bounds]
    n = np.diff(before)
    points = np.append(0, np.cumsum(_FIRST[data]))
    out = []
    for t in np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), 0):
        byte = np.where(t < n, at[np.minimum(before[:-1] + t, len(at) - 1)], bounds[1:])
        out.append(points[byte] - points[bounds[:-1]])
    return n, out[0], out[1]


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of an Arrow text column without nulls."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, bounds - bounds[0]


def _giant_cuts(giants: DataFrame, chunk: int) -> DataFrame:
    """key, n, low, high of texts (key, h1, h2, text) that are scanned in chunks of many tasks."""
    import pyarrow as pa

    def split(batches):
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                data = memoryview(text.as_buffer())
                for k in range(0, len(data), 64 * chunk):
                    parts = [bytes(data[i : i + chunk]) for i in range(k, min(len(data), k + 64 * chunk), chunk)]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(parts)), pa.array(range(k // chunk, k // chunk + len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["key", "k", "data"])

    def summed(batches):
        for batch in batches:
            rows = summaries(*_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, np.ascontiguousarray(rows.T))], ["key", "k", "e0", "c0", "e1", "c1", "points"])

    def resolved(table):
        table = table.sort_by("k")
        h1, h2 = table.column("h1")[0].as_py(), table.column("h2")[0].as_py()
        whole = scanned(np.stack([table.column(c).to_numpy() for c in ("e0", "c0", "e1", "c1", "points")], 1))
        state = np.append(0, whole[:-1, 0])  # every text begins outside
        n, points, tokens = int(whole[-1, 1]), np.append(0, whole[:, 4]), np.append(0, whole[:, 1])
        rows = []
        for which, t in enumerate(sorted((h1 % (n + 1), h2 % (n + 1)))):
            k = int(np.searchsorted(tokens[1:], t, "right"))
            rows.append((which, k, int(state[k]), t - int(tokens[k]), int(points[k])) if t < n else (which, -1, 0, 0, int(points[-1])))
        key = table.column("key")[0].as_py()
        which, k, inside, token, before = zip(*rows, strict=True)
        return pa.table({"key": [key] * 2, "n": pa.array([n] * 2, pa.int64()), "which": pa.array(which, pa.int32()), "k": pa.array(k, pa.int32()), "inside": pa.array(inside, pa.int32()), "token": pa.array(token, pa.int64()), "before": pa.array(before, pa.int64())})

    def found(batches):
        for batch in batches:
            data, inside, token, before = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
            at = [b if d is None else b + place(np.frombuffer(d, np.uint8), i == 1, t) for d, i, t, b in zip(data, inside, token, before, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(at, pa.int64())], ["key", "n", "which", "at"])

    chunks = giants.select("key", F.col("text").cast("binary")).mapInArrow(split, "key string, k int, data binary")
    chunks = materialize(chunks.repartition("key", "k"), "fim-chunks")
    sums = chunks.mapInArrow(summed, "key string, k int, e0 bigint, c0 bigint, e1 bigint, c1 bigint, points bigint")
    sums = sums.join(giants.select("key", "h1", "h2"), "key")
    at = sums.groupBy("key").applyInArrow(resolved, "key string, n bigint, which int, k int, inside int, token bigint, before bigint")
    at = materialize(at, "fim-cuts")
    picked = F.broadcast(at) if at.count() <= MOST_IDS else at
    rows = picked.where("k >= 0").join(chunks, ["key", "k"]).select("key", "n", "which", "data", "inside", "token", "before")
    ends = at.where("k < 0").select("key", "n", "which", F.lit(None).cast("binary").alias("data"), "inside", "token", "before")
    places = rows.unionByName(ends).mapInArrow(found, "key string, n bigint, which int, at bigint")
    return places.groupBy("key").agg(F.max("n").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))


def drawn(id_: Column, seed: str, k: int) -> Column:
    """The k-th (from 0) 8-digit group of the digest of `seed:id` as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE, keep: list[str] | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """The kept columns (the id, if none are named), n (tokens), form, prefix_chars, middle_chars and output of every row."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    text, id_ = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    rows = docs.select(row.alias("row"), id_.cast("string").alias("id"), text.alias("text"), drawn(id_, seed, 0).alias("h1"), drawn(id_, seed, 1).alias("h2"), drawn(id_, seed, 2).alias("h3"), drawn(id_, seed, 3).alias("h4"))

    def small(batches):
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in ("text", "h1", "h2")}
            n, low, high = cuts(*_bytes(batch.column(at["text"])), batch.column(at["h1"]).to_numpy(), batch.column(at["h2"]).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(low), pa.array(high)], [*batch.schema.names, "n", "low", "high"])

    kind = rows.drop("id").schema
    done = rows.where(F.octet_length("text") <= giant).drop("id").mapInArrow(small, kind.add("n", "long").add("low", "long").add("high", "long"))
    large = rows.where(F.octet_length("text") > giant).withColumn("key", F.sha2(F.concat_ws(":", F.coalesce("id", F.lit("null")), "text"), 256)).drop("id")
    large = materialize(large, "fim-giants")
    if not large.isEmpty():
        places = _giant_cuts(large.select("key", "h1", "h2", "text").dropDuplicates(["key"]), chunk)
        places = materialize(places, "fim-places")
        places = F.broadcast(places) if places.count() <= MOST_IDS else places
        done = done.unionByName(large.join(places, "key").drop("key"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.pmod("h3", F.lit(100)) >= cut_share)
    done = done.withColumn("form", F.when(plain, "plain").when(F.pmod("h4", F.lit(100)) < spm_share, "spm").otherwise("psm"))
    low, high = F.col("low").cast("int"), F.col("high").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), low), F.substring("text", low + 1, high - low), F.substring("text", high + 1, F.length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    done = done.select("row", "n", "form", cut(F.col("low")).alias("prefix_chars"), cut(F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))
    return done.select(*(["row.*"] if keep else []), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No mark stands in a text that is cut, so each is found where it was put."""
    p, s, m = (F.instr(output, F.lit(mark)) for mark in (PREFIX, SUFFIX, MIDDLE))
    end = F.length(output)
    middle = F.substring(output, m + 3, end)
    psm = F.concat(F.substring(output, F.lit(4), s - 4), middle, F.substring(output, s + 3, m - s - 3))
    spm = F.concat(F.substring(output, p + 3, m - p - 3), middle, F.substring(output, F.lit(4), p - 4))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of query op13 from transform()'s."""
    return rows.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM h),
c AS (SELECT *, len(w) AS n, CAST(least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS lo, CAST(greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(w[1:lo], '') AS prefix, array_to_string(w[lo + 1:hi], '') AS middle, array_to_string(w[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
