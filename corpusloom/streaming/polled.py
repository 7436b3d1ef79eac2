"""Events of a session polled by a cursor, as a source of micro-batches.

The cursor is a time: a batch has the events from it on to the end of a step, and moves it
one microsecond past its own last event. Spark keeps where each batch ends before it is
run, and takes the next one only after its sink is done; a run that was killed in between
asks for the same events again. A source isn't told where it begins again, so it keeps the
furthest end that it has planned; a new run plans from there, and without that file its
first batch has all that is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpusloom.sources.stores import open_store


class _Group(InputPartition):
    def __init__(self, path: str, group: int, start: int, end: int):
        super().__init__(None)
        self.path, self.group, self.start, self.end = path, group, start, end


class PolledReader(DataSourceStreamReader):
    """Row groups of Parquet files whose times, by their footers, fall into a batch."""

    def __init__(self, options: dict, names: list[str]):
        self.root, self.at = options["path"], options.get("time", "ts")
        self.step = int(options.get("step_seconds", "86400")) * 1_000_000
        self.names = names
        self.progress = options.get("progress")
        self.asked = self._planned()

    def _planned(self) -> int | None:
        """The furthest end that was planned; None where none is kept."""
        if self.progress is None:
            return None
        store, base = open_store(self.progress)
        if not store.get_file_info(f"{base}/planned").is_file:
            return min((low for _, _, low, _ in self._groups()), default=None)
        with store.open_input_file(f"{base}/planned") as file:
            return int(file.read())

    def _keep(self, end: int) -> None:
        if self.progress is not None:
            store, base = open_store(self.progress)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/.planned") as file:
                file.write(str(end).encode())
            store.move(f"{base}/.planned", f"{base}/planned")

    def _groups(self) -> Iterator[tuple[str, int, int, int]]:
        """(path, row group, first and last time in microseconds) of all that is there now; footers only."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = open_store(self.root)
        info = store.get_file_info(base)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base))
        for path in sorted(i.path for i in found if i.is_file and i.path.endswith(".parquet")):
            with store.open_input_file(path) as file:
                meta = pq.ParquetFile(file).metadata
            column = [meta.schema.column(k).path for k in range(meta.num_columns)].index(self.at)
            for k in range(meta.num_row_groups):
                stats = meta.row_group(k).column(column).statistics
                if stats is not None and stats.has_min_max:
                    low, high = (pa.scalar(x).cast(pa.timestamp("us")).value for x in (stats.min, stats.max))
                    yield path, k, low, high

    def initialOffset(self) -> dict:
        return {"cursor": min((low for _, _, low, _ in self._groups()), default=0)}

    def latestOffset(self) -> dict:
        """The end of the next step, or one past the last event where that comes before; the cursor stays where there is nothing new."""
        last = max((high for *_, high in self._groups()), default=None)
        if self.asked is None:  # where Spark begins isn't known
            return {"cursor": 0 if last is None else last + 1}
        if last is not None and last + 1 > self.asked:
            later = min((max(low, self.asked) for _, _, low, high in self._groups() if high >= self.asked), default=self.asked)
            self.asked = min(max(self.asked, later) + self.step, last + 1)
        return {"cursor": self.asked}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.asked = max(self.asked or 0, end["cursor"])
        self._keep(self.asked)
        return [_Group(path, k, start["cursor"], end["cursor"]) for path, k, low, high in self._groups() if high >= start["cursor"] and low < end["cursor"]]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, _ = open_store(self.root)
        with store.open_input_file(partition.path) as file:
            table = pq.ParquetFile(file).read_row_group(partition.group, columns=self.names)
        at = pc.cast(table.column(self.at).cast(pa.timestamp("us")), pa.int64())
        inside = pc.and_(pc.greater_equal(at, partition.start), pc.less(at, partition.end))
        yield from table.filter(inside).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing to give back: events stay where they are."""


class PolledEvents(DataSource):
    """Format ``polled_events``; options path, time (a column), step_seconds, and progress, a folder of one query's own. The schema is given by the reader."""

    @classmethod
    def name(cls) -> str:
        return "polled_events"

    def schema(self) -> str:
        raise ValueError("give the events' schema")

    def streamReader(self, schema) -> PolledReader:
        return PolledReader(dict(self.options), schema.names)


def polled(spark: SparkSession, path: str, schema: str, progress: str | None = None, time: str = "ts", step_seconds: int = 86_400):
    """A stream of the events below ``path``. Events without a time are never polled."""
    spark.dataSource.register(PolledEvents)
    reader = spark.readStream.format("polled_events").schema(schema).option("path", path).option("time", time).option("step_seconds", str(step_seconds))
    return (reader.option("progress", progress) if progress else reader).load()
