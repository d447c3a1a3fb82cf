"""Results as versions of a folder: facts, relationships and report are written by one job and appear together or not at all.

Tasks write JSON lines below ``_staging``; the driver's commit moves what the successful attempts
named and adds one manifest, ``_versions/<n>.json``, that lists the files of the version. Readers
go by the last manifest, so they never see half a run; what failed or doubled attempts have
written goes with the staging folder.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "factloom_results"
SCHEMA = "kind string, body string"
_STAGING, _VERSIONS = "_staging", "_versions"


@dataclass
class Written(WriterCommitMessage):
    """The files that one attempt wrote: (kind, name, rows, sha256)."""

    files: list[tuple[str, str, int, str]]


class ResultsWriter(DataSourceWriter):
    def __init__(self, path: str, replace: bool) -> None:
        self.path, self.replace, self.run = path, replace, uuid.uuid4().hex
        # made here and never by a task: once an abort has removed it, tasks still running cannot write below it
        files, root = self._place()
        files.create_dir(posixpath.join(root, _STAGING, self.run))

    def _place(self) -> tuple[fs.FileSystem, str]:
        return _place(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = self._place()
        context = TaskContext.get()
        attempt = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        open_: dict[str, list] = {}
        try:
            for row in iterator:
                if row.kind not in open_:
                    name = f"{row.kind}-{self.run[:8]}-{attempt}.jsonl"
                    open_[row.kind] = [files.open_output_stream(posixpath.join(root, _STAGING, self.run, name)), name, 0, hashlib.sha256()]
                line = row.body.encode() + b"\n"
                held = open_[row.kind]
                held[0].write(line)
                held[2] += 1
                held[3].update(line)
        finally:
            for held in open_.values():
                held[0].close()
        return Written([(kind, name, rows, sha.hexdigest()) for kind, (_, name, rows, sha) in open_.items()])

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._place()
        last, known = _last(files, root)
        listed = [] if self.replace or known is None else known["files"]
        for kind, name, rows, sha in (f for m in messages if m for f in m.files):
            to = posixpath.join(kind, name)
            files.create_dir(posixpath.join(root, kind))
            files.move(posixpath.join(root, _STAGING, self.run, name), posixpath.join(root, to))
            listed = [*listed, {"kind": kind, "file": to, "rows": rows, "sha256": sha}]
        files.create_dir(posixpath.join(root, _VERSIONS))
        # written aside and renamed: a manifest is whole or absent
        aside = posixpath.join(root, _VERSIONS, f".{self.run}")
        with files.open_output_stream(aside) as out:
            out.write(json.dumps({"version": last + 1, "run": self.run, "files": listed}).encode())
        files.move(aside, posixpath.join(root, _VERSIONS, f"{last + 1:08d}.json"))
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        files, root = self._place()
        staging = posixpath.join(root, _STAGING, self.run)
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _last(files: fs.FileSystem, root: str) -> tuple[int, dict | None]:
    """Number and contents of the last manifest; 0 and None before the first."""
    found = files.get_file_info(fs.FileSelector(posixpath.join(root, _VERSIONS), allow_not_found=True))
    names = sorted(i.path for i in found if i.base_name.endswith(".json"))
    if not names:
        return 0, None
    with files.open_input_stream(names[-1]) as source:
        said = json.loads(source.read())
    return said["version"], said


class ResultsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> ResultsWriter:
        return ResultsWriter(self.options["path"], overwrite)


def publish(path: str, replace: bool = True, **results: DataFrame) -> None:
    """Write frames, each under its name as kind, as one new version of ``path``; with ``replace`` false, added to the last version."""
    bodies = [d.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in d.columns])).alias("body")) for kind, d in results.items()]
    out = bodies[0]
    for more in bodies[1:]:
        out = out.unionByName(more)
    out.sparkSession.dataSource.register(ResultsSource)
    out.write.format(FORMAT).mode("overwrite" if replace else "append").save(path)


def published(spark: SparkSession, path: str, kind: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """The rows of a kind in the last version, or in one that is named; without a version or a file of that kind, none."""
    files, root = _place(path)
    said = _last(files, root)[1]
    if version is not None:
        with files.open_input_stream(posixpath.join(root, _VERSIONS, f"{version:08d}.json")) as source:
            said = json.loads(source.read())
    names = [f"{path.rstrip('/')}/{f['file']}" for f in (said or {"files": []})["files"] if f["kind"] == kind]
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)
