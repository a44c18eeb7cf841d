"""A folder of run records as a Spark data source: `spark.read.format("runs").load(root)`, `df.write.format("runs").save(root)`.

root is a folder that driver and executors reach by path. Rows are SCHEMA. Reading lists the folder's names and plans them as partitions
of FOLDERS runs; filters on run_id leave folders unopened, one on status leaves what else a record holds unread. Writing puts each run into
a folder of its task's own, out of sight; a commit moves them into place, an abort leaves nothing.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from vicinal.sources.records import Record, save_record

SCHEMA = "run_id string, status string, params map<string,string>, metrics map<string,double>, tags map<string,string>"
#: Runs of a partition.
FOLDERS = 256
#: Where tasks put runs until they are committed; names that begin so aren't runs.
STAGED = "_staged"


def folder(path: str) -> Path:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"runs are kept in a mounted folder, not in {path}")
    return Path(path.removeprefix("file://"))


class RunStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        return Writer(self.options["path"], overwrite)


@dataclass
class Runs(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.root = str(folder(path))
        self.ids: set[str] | None = None
        self.statuses: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes run_id and status compared with values; the rest is left to Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute not in (("run_id",), ("status",)):
                yield f
            elif f.attribute == ("run_id",):
                self.ids = wanted if self.ids is None else self.ids & wanted
            else:
                self.statuses = wanted if self.statuses is None else self.statuses & wanted

    def partitions(self) -> list[Runs]:
        root = Path(self.root)
        names = sorted(x.name for x in os.scandir(root) if x.is_dir() and not x.name.startswith("_")) if root.is_dir() else []
        names = [n for n in names if self.ids is None or n in self.ids]
        return [Runs(names[i : i + FOLDERS]) for i in range(0, len(names), FOLDERS)] or [Runs([])]

    def read(self, partition: Runs) -> Iterator[tuple]:
        """Folders without a readable record are passed over: a run may be under way."""
        for name in partition.names:
            try:
                r = Record(**json.loads((Path(self.root) / name / "record.json").read_text()))
            except (OSError, ValueError, TypeError):
                continue
            if self.statuses is None or r.status in self.statuses:
                text = lambda d: {k: None if v is None else str(v) for k, v in d.items()}
                yield (r.run_id, r.status, text(r.params), {k: None if v is None else float(v) for k, v in r.metrics.items()}, text(r.tags))


@dataclass
class Written(WriterCommitMessage):
    place: str
    names: list[str]


class Writer(DataSourceWriter):
    """Appending an id that is there is an error, and so is one id twice; nothing is moved then. Overwriting replaces the folder's runs."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.root, self.overwrite = str(folder(path)), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        place = Path(self.root) / STAGED / self.job / uuid.uuid4().hex
        place.mkdir(parents=True)
        names = []
        for r in iterator:
            if not r.run_id or r.run_id.startswith("_") or "/" in r.run_id:
                raise ValueError(f"a run can't be called {r.run_id!r}")
            save_record(place, Record(r.run_id, dict(r.params or {}), dict(r.metrics or {}), dict(r.tags or {}), r.status or "success"))
            names.append(r.run_id)
        return Written(str(place), names)

    def commit(self, messages: list[Written | None]) -> None:
        root = Path(self.root)
        done = [m for m in messages if m]
        names = [n for m in done for n in m.names]
        there = {x.name for x in root.iterdir() if not x.name.startswith("_")} if root.is_dir() else set()
        wrong = sorted({n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else there & set(names) if not self.overwrite else ())
        if wrong:
            self.abort(messages)
            raise ValueError(f"runs are there already, or twice: {', '.join(wrong[:5])}")
        for n in there if self.overwrite else ():
            shutil.rmtree(root / n)
        for m in done:
            for n in m.names:
                os.replace(Path(m.place) / n, root / n)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What tasks wrote goes, tried again or not; their common folder too if no other job uses it."""
        shutil.rmtree(Path(self.root) / STAGED / self.job, ignore_errors=True)
        staged = Path(self.root) / STAGED
        if staged.is_dir() and not any(staged.iterdir()):
            staged.rmdir()


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RunStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
