"""Gold sets, reports and event feeds as Spark data sources: ``register(spark)``, then ``spark.read.format("goldset")`` and so on.

* ``goldset`` reads a folder (or file) of JSON gold sets, a partition a file; cases are rows, lists of values stay JSON text.
* ``report`` writes a result as one Markdown file (option ``title``), by tasks that hand their lines to the commit; it is bounded by ``most`` rows
  (10,000 by default), beyond which the write fails, and appears whole or not at all.
* ``eventfeed`` is a stream sink of server-sent events: rows with ``event`` and other columns become frames, one file a task and batch. A batch's
  files become visible by its commit; a batch that runs again replaces them.

Paths are local or mounted folders that driver and executors share: Python's data sources have no access to Spark's file systems.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _local(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} is not a local or mounted folder")
    return parts.path


class GoldSets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "goldset"

    def schema(self) -> str:
        return "file string, id string, question string, category string, fields string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GoldReader(_local(self.options["path"]))


class _GoldReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(f"{self.path}/*.json")) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            held = json.load(f)
        cases = held if isinstance(held, list) else held.get("cases") or held.get("queries") or []
        for case in cases:
            rest = {k: v for k, v in case.items() if k not in ("id", "question", "query", "category")}
            asked = case.get("question", case.get("query"))
            yield os.path.basename(partition.value), None if case.get("id") is None else str(case["id"]), asked, case.get("category"), json.dumps(rest, ensure_ascii=False, sort_keys=True)


@dataclass
class _Lines(WriterCommitMessage):
    lines: list[str]


class Reports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ReportWriter(_local(self.options["path"]), self.options.get("title", "Report"), int(self.options.get("most", "10000")), schema.names, overwrite)


class _ReportWriter(DataSourceWriter):
    def __init__(self, path: str, title: str, most: int, names: list[str], overwrite: bool) -> None:
        self.path, self.title, self.most, self.names, self.overwrite = path, title, most, names, overwrite

    def _line(self, cells) -> str:
        return "| " + " | ".join("" if c is None else str(c).replace("\n", " ").replace("|", "\\|") for c in cells) + " |"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        lines = []
        for row in rows:
            lines.append(self._line(row))
            if len(lines) > self.most:
                raise ValueError(f"a report of more than {self.most} rows")
        return _Lines(lines)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        lines = [line for m in messages if m is not None for line in m.lines]
        if len(lines) > self.most:
            raise ValueError(f"a report of more than {self.most} rows")
        if os.path.exists(self.path) and not self.overwrite:
            raise FileExistsError(self.path)
        ready = f"{self.path}.{uuid.uuid4().hex}"
        with open(ready, "w", encoding="utf-8") as f:
            f.write("\n".join([f"# {self.title}", "", self._line(self.names), self._line(["---"] * len(self.names)), *lines, ""]))
        os.replace(ready, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass


@dataclass
class _File(WriterCommitMessage):
    path: str


class EventFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eventfeed"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _FeedWriter(_local(self.options["path"]))


def frame(row: Row) -> str:
    """A row as a server-sent event; its other columns are the data."""
    held = row.asDict()
    event = held.pop("event")
    return f"event: {event}\ndata: {json.dumps(held, ensure_ascii=False, default=str)}\n\n"


class _FeedWriter(DataSourceStreamWriter):
    def __init__(self, path: str) -> None:
        self.path = path
        os.makedirs(f"{path}/.open", exist_ok=True)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        path = f"{self.path}/.open/{uuid.uuid4().hex}"
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(frame(r) for r in rows)
        return _File(path)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        ready = f"{self.path}/.open/batch-{batchId}-{uuid.uuid4().hex}"
        os.makedirs(ready)
        for i, m in enumerate(m for m in messages if m is not None):
            if os.path.getsize(m.path):
                os.replace(m.path, f"{ready}/part-{i:05d}.sse")
            else:
                os.remove(m.path)
        final = f"{self.path}/batch={batchId}"
        shutil.rmtree(final, ignore_errors=True)
        os.replace(ready, final)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def register(spark: SparkSession) -> None:
    for source in (GoldSets, Reports, EventFeed):
        spark.dataSource.register(source)
