"""A stream of lines whose offsets are rows, so that a micro-batch has a bound on its rows.

File sources bound a micro-batch by files only: one large file is one batch. Here an offset
is a file, a byte and a row. The driver looks for line ends, as many as a batch may have, and
tasks read the bytes between two offsets.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logwarden.schemas import MICRO_BATCH



class Part(InputPartition):
    """Whole lines of a file between two bytes."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class RowReader(DataSourceStreamReader):
    def __init__(self, folder: str, rows: int):
        self.folder, self.rows = folder, rows
        self.at: dict | None = None

    def _files(self, after: str) -> list[str]:
        names = sorted(n for n in os.listdir(self.folder) if not n.startswith(("_", ".")))
        return [n for n in names if n >= after]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "byte": 0, "row": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """At most ``rows`` lines past the offset before. An unfinished last line waits for its end."""
        at = dict(self.at or self.initialOffset())
        left = self.rows
        for name in self._files(at["file"]):
            byte = at["byte"] if name == at["file"] else 0
            with open(os.path.join(self.folder, name), "rb") as f:
                f.seek(byte)
                while left and (line := f.readline()).endswith(b"\n"):
                    byte, left = byte + len(line), left - 1
                    at = {"file": name, "byte": byte, "row": at["row"] + 1}
            if not left:
                break
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Part]:
        # After a restart the last batch of the log is planned first; reading goes on from its end.
        if self.at is None:
            self.at = end
        out = []
        for name in self._files(start["file"]):
            if name > end["file"]:
                break
            path = os.path.join(self.folder, name)
            low = start["byte"] if name == start["file"] else 0
            high = end["byte"] if name == end["file"] else os.path.getsize(path)
            if low < high:
                out.append(Part(path, low, high))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.stop and (line := f.readline()).endswith(b"\n"):
                at += len(line)
                yield (line.rstrip(b"\r\n").decode("utf-8", errors="replace"),)

    def commit(self, end: dict) -> None:
        pass


class RowBatches(DataSource):
    """Lines of the files of a folder, in order of their names. Options: ``path``, ``rows``.

    The folder is one that the driver and all executors see. Files only grow, and new ones sort
    behind the others.
    """

    @classmethod
    def name(cls) -> str:
        return "row_batches"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> RowReader:  # noqa: N802
        return RowReader(self.options["path"], int(self.options.get("rows", MICRO_BATCH)))


def stream_rows(spark: SparkSession, folder: str, rows: int = MICRO_BATCH) -> DataFrame:
    """A stream of lines (``value``) of which no micro-batch has more than ``rows``."""
    spark.dataSource.register(RowBatches)
    return spark.readStream.format("row_batches").option("path", folder).option("rows", rows).load()
