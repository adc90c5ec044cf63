"""A partitioned log as a Spark streaming source with one offset per partition.

The log is a folder ``partition=<n>`` per partition, holding text segments named by the offset of
their first record, one record a line. A record counts once its line is ended. Offsets are what
the checkpoint stores, so a restarted query goes on where the last committed batch ended. Folders may
lie in any store pyarrow reads, and executors read them from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "offset_log"
ROWS_PER_TASK = 100_000


class OffsetError(ValueError):
    """A start position that the log does not hold."""


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Segments:
    """The segments of every partition: {partition: [(first offset, path), ...]} in order."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.store, root = _store(path)
        self.parts: dict[int, list[tuple[int, str]]] = {}
        for info in self.store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            folder = info.path.rsplit("/", 2)[-2]
            name = info.base_name
            if info.is_file and folder.startswith("partition=") and name.endswith(".log"):
                self.parts.setdefault(int(folder.removeprefix("partition=")), []).append((int(name[:-4]), info.path))
        for segments in self.parts.values():
            segments.sort()

    def lines(self, path: str) -> Iterator[bytes]:
        """Ended lines of a segment, without their ends."""
        left = b""
        with self.store.open_input_stream(path) as stream:
            while chunk := stream.read(1 << 20):
                *whole, left = (left + chunk).split(b"\n")
                yield from whole

    def earliest(self) -> dict[str, int]:
        return {str(p): s[0][0] for p, s in sorted(self.parts.items())}

    def latest(self) -> dict[str, int]:
        """The offset after the last record: only each partition's last segment is counted."""
        return {str(p): s[-1][0] + sum(1 for _ in self.lines(s[-1][1])) for p, s in sorted(self.parts.items())}


class Slice(InputPartition):
    """Records [start, end) of one partition."""

    def __init__(self, partition: int, start: int, end: int):
        self.partition, self.start, self.end = partition, start, end


class OffsetLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.start = options.get("start", "earliest")
        self.rows = int(options.get("rowspertask", ROWS_PER_TASK))
        self.fail_on_loss = options.get("failondataloss", "true").lower() != "false"

    def initialOffset(self) -> dict:
        """Where a query without a checkpoint starts: earliest, latest, or offsets as JSON."""
        log = Segments(self.path)
        if self.start in ("earliest", "latest"):
            return getattr(log, self.start)()
        try:
            wanted = {str(int(p)): int(o) for p, o in json.loads(self.start).items()}
        except (ValueError, AttributeError, TypeError):
            raise OffsetError(f"start is earliest, latest or offsets as JSON, not {self.start}") from None
        first, last = log.earliest(), log.latest()
        for p, offset in wanted.items():
            if p not in first:
                raise OffsetError(f"no partition {p}")
            if not first[p] <= offset <= last[p]:
                raise OffsetError(f"partition {p} holds offsets {first[p]} to {last[p]}, not {offset}")
        return first | wanted

    def latestOffset(self) -> dict:
        return Segments(self.path).latest()

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        first = Segments(self.path).earliest()
        slices = []
        for p, stop in end.items():
            # A partition that was added since starts at its first record.
            at = start.get(p, first.get(p, 0))
            if at < first.get(p, 0):
                if self.fail_on_loss:
                    raise OffsetError(f"records {at} to {first[p]} of partition {p} are gone")
                at = first[p]
            slices += [Slice(int(p), a, min(a + self.rows, stop)) for a in range(at, stop, self.rows)]
        return slices

    def read(self, partition: Slice) -> Iterator[tuple]:
        log = Segments(self.path)
        segments = log.parts.get(partition.partition, [])
        for i, (first, path) in enumerate(segments):
            after = segments[i + 1][0] if i + 1 < len(segments) else partition.end
            if after <= partition.start or first >= partition.end:
                continue
            for offset, line in enumerate(log.lines(path), first):
                if offset >= min(partition.end, after):
                    break
                if offset >= partition.start:
                    yield partition.partition, offset, line.decode(errors="replace")

    def commit(self, end: dict) -> None:
        pass


class OffsetLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "partition int, offset long, value string"

    def streamReader(self, schema) -> OffsetLogReader:
        return OffsetLogReader(dict(self.options))


def offset_log(spark: SparkSession, path: str, start: str = "earliest", **options: str) -> DataFrame:
    """The log as a stream of (partition, offset, value); ``start`` matters for the first run only."""
    spark.dataSource.register(OffsetLog)
    return spark.readStream.format(FORMAT).option("path", path).option("start", start).options(**options).load()
