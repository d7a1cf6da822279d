"""``artifacts``: a sink that writes one file for each row (name, content), such as snapshots or a study's pages by slug.

A task writes its files below a staging folder of the job, one folder for each attempt; the commit moves those of the tasks
that ended well to their places and drops the rest.  A task that fails, is repeated or runs twice leaves nothing behind, and
an aborted job removes its staging folder.  Names with the same text are the last row's of the task with the largest number;
names may have folders in them but can't leave the path.  Paths are those that Arrow's file systems know: local, hdfs, s3, gs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING, MOVERS = "_staging", 16


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def safe_name(name: str) -> str:
    """A relative name without steps upwards."""
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if not parts or ".." in parts or parts[0] == STAGING:
        raise ValueError(f"no name of an artifact: {name!r}")
    return "/".join(parts)


@dataclass
class Written(WriterCommitMessage):
    task: int
    folder: str
    names: list[str]


class Artifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArtifactWriter(self.options["path"].rstrip("/"), overwrite)


class ArtifactWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self):
        at, root = _place(self.path)
        return at, root, f"{root}/{STAGING}/{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        at, _, staging = self._staging()
        task = TaskContext.get()
        folder, names = f"{staging}/{task.partitionId()}-{task.taskAttemptId()}", {}
        try:
            for row in iterator:
                name = safe_name(row["name"])
                path = f"{folder}/{name}"
                at.create_dir(path.rpartition("/")[0], recursive=True)
                with at.open_output_stream(path) as out:
                    out.write((row["content"] or "").encode("utf-8", "surrogatepass"))
                names[name] = None
        except BaseException:
            _drop(at, folder)
            raise
        return Written(task.partitionId(), folder, list(names))

    def commit(self, messages: list[Written]) -> None:
        at, root, staging = self._staging()
        done = [m for m in sorted((m for m in messages if m), key=lambda m: m.task)]
        if self.overwrite:
            _clear(at, root)
        moves = {name: m.folder for m in done for name in m.names}
        for folder in {f"{root}/{name}".rpartition("/")[0] for name in moves} | {root}:
            at.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda x: at.move(f"{x[1]}/{x[0]}", f"{root}/{x[0]}"), moves.items()))
        _drop(at, staging)

    def abort(self, messages: list[Written]) -> None:
        at, _, staging = self._staging()
        _drop(at, staging)


def _drop(at, folder: str) -> None:
    from pyarrow import fs

    if at.get_file_info(folder).type == fs.FileType.Directory:
        at.delete_dir(folder)


def _clear(at, root: str) -> None:
    """Everything at the path but what is being written."""
    from pyarrow import fs

    if at.get_file_info(root).type != fs.FileType.Directory:
        return
    for info in at.get_file_info(fs.FileSelector(root)):
        if info.base_name != STAGING:
            at.delete_dir(info.path) if info.type == fs.FileType.Directory else at.delete_file(info.path)


def write_artifacts(spark: SparkSession, rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (name, content) rows, a file each."""
    spark.dataSource.register(Artifacts)
    rows.select("name", "content").write.format("artifacts").option("path", path).mode(mode).save()
