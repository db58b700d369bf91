"""A bounded table as a live stream at the pace of its messages: a Python data source with row offsets.

Rows go out in the order of file names and of rows in files (`ordered_files` writes a table so). An offset is a file and a row in it, so a
stream stops and goes on between any two rows. The reader admits rows by time: one after each pause, or what the pauses since the
start allow. Footers are read as offsets reach their files; the tasks read only the row groups that hold their rows.

Options: path (folder of Parquet files), pause (seconds between messages, 0 if unset: all at once), rows (messages after each pause, 1), clock
(`wall`; `steps`: every look for new rows counts as one pause, for runs that shall not wait), progress (folder that keeps the position of
the last planned batch, so that a restarted reader counts on from there), end (a timestamp column: after the last row one more comes out with the
end of all time there and nulls elsewhere, which moves the watermark past every row).

Defined cases: no files and files without rows give no rows (and the end mark, if asked for); other columns of the files are not read.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from skywright.sources.sinks import place_of

NAME = "skywright_replay"
#: The end of all time, as far as nanoseconds of 64 bits reach.
END = datetime(2262, 1, 1)
#: Rows of one task at most.
SLICE = 1 << 20


class _Slice(InputPartition):
    def __init__(self, path: str | None, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceStreamReader):
    def __init__(self, options, schema: T.StructType):
        import pyarrow.fs as fs

        self.schema, self.end = schema, options.get("end")
        self.pause, self.rows = float(options.get("pause", 0)), int(options.get("rows", 1))
        self.steps = options.get("clock", "wall") == "steps"
        self.place, base = place_of(options["path"])
        found = self.place.get_file_info(fs.FileSelector(base, recursive=True))
        self.files = sorted(f.path for f in found if f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
        self.sizes: dict[int, int] = {}
        self.progress = options.get("progress")
        self.at = self._planned() or {"file": 0, "row": 0}
        self.start, self.admitted, self.looks = time.monotonic(), 0, 0

    def _size(self, k: int) -> int:
        import pyarrow.parquet as pq

        if k not in self.sizes:
            with self.place.open_input_file(self.files[k]) as f:
                self.sizes[k] = pq.ParquetFile(f).metadata.num_rows
        return self.sizes[k]

    def _planned(self) -> dict | None:
        import json

        import pyarrow.fs as fs

        if not self.progress:
            return None
        place, base = place_of(f"{self.progress}/position")
        if place.get_file_info(base).type == fs.FileType.NotFound:
            return None
        with place.open_input_stream(base) as f:
            return json.loads(f.read())

    def _plan(self, at: dict) -> None:
        import json

        self.at = max(self.at, at, key=lambda x: (x["file"], x["row"]))
        if self.progress:
            place, base = place_of(f"{self.progress}/position")
            place.create_dir(base.rpartition("/")[0], recursive=True)
            with place.open_output_stream(f"{base}-new") as f:
                f.write(json.dumps(self.at).encode())
            place.move(f"{base}-new", base)

    def _after(self, at: dict, rows: int | None) -> dict:
        """The offset `rows` rows on (None: at the end). The end mark is the row after the last file."""
        k, row = at["file"], at["row"]
        while k < len(self.files) and (rows is None or rows > 0):
            here = self._size(k) - row
            if rows is not None and rows < here:
                return {"file": k, "row": row + rows}
            k, row, rows = k + 1, 0, None if rows is None else rows - here
        if k == len(self.files) and self.end and row == 0 and (rows is None or rows > 0):
            row = 1
        return {"file": k, "row": row}

    def initialOffset(self) -> dict:
        return {"file": 0, "row": 0}

    def latestOffset(self) -> dict:
        if not self.pause:
            return self._after(self.at, None)
        self.looks += 1
        passed = self.looks if self.steps else 1 + int((time.monotonic() - self.start) / self.pause)
        more = passed * self.rows - self.admitted
        self.admitted += more
        self.at = self._after(self.at, more)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for k in range(start["file"], min(end["file"] + 1, len(self.files))):
            first, last = start["row"] if k == start["file"] else 0, end["row"] if k == end["file"] else self._size(k)
            out += [_Slice(self.files[k], a, min(a + SLICE, last)) for a in range(first, last, SLICE)]
        if end["file"] == len(self.files) and end["row"] and not (start["file"] == end["file"] and start["row"]):
            out.append(_Slice(None, 0, 1))
        self._plan(end)
        return out

    def read(self, partition: _Slice) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if partition.path is None:
            yield pa.RecordBatch.from_pylist([{f.name: END if f.name == self.end else None for f in schema}], schema)
            return
        with self.place.open_input_file(partition.path) as f:
            file, before = pq.ParquetFile(f), 0
            for g in range(file.metadata.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                a, b = max(partition.first - before, 0), min(partition.last - before, n)
                if a < b:
                    table = file.read_row_group(g, columns=schema.names).slice(a, b - a).select(schema.names).cast(schema)
                    yield from table.to_batches(max_chunksize=10_000)
                before += n

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Replay(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("a replay needs the schema of its columns")

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Reader(self.options, schema)


def replay_rows(spark: SparkSession, schema: T.StructType | str, path: str, pause: float = 0, rows: int = 1, clock: str = "wall", progress: str | None = None, end: str | None = None) -> DataFrame:
    """The rows of the Parquet files in a folder as a stream; the options are the module's."""
    spark.dataSource.register(Replay)
    options = {"path": path, "pause": str(pause), "rows": str(rows), "clock": clock} | ({"progress": progress} if progress else {}) | ({"end": end} if end else {})
    return spark.readStream.format(NAME).schema(schema).options(**options).load()


def ordered_files(df: DataFrame, order: list[str], path: str) -> None:
    """Writes df so that its files, by name, and the rows in them go in order (a range for each file, sorted in tasks of their own)."""
    df.orderBy(*[F.col(c) for c in order]).write.mode("overwrite").parquet(path)
