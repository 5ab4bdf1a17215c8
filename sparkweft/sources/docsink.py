"""A sink that writes many JSON documents, each a file of its own, and leaves unchanged ones alone.

    docsink.register(spark)
    docs.write.format("json_documents").mode("append").option("root", folder).save()

Rows are (path, doc): where below the root a document goes, and its text.
"""

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: The folder below the root where files wait for the commit.
WAITING = ".waiting"


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder in it. On a cluster it is one that all executors reach."""
    system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    return system, base.rstrip("/")


def shown(doc: str) -> bytes:
    """The file of a document: two spaces a level, other letters as they are, a newline at its end."""
    return (json.dumps(json.loads(doc), indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode()


def safe(path: str) -> str:
    """A path below the root; ValueError for one that leads out of it or into the folder of waiting files."""
    parts = path.split("/")
    if not path or "" in parts or "." in parts or ".." in parts or parts[0] == WAITING:
        raise ValueError(f"no path below the root: {path!r}")
    return path


@dataclass
class Waiting(WriterCommitMessage):
    """What a task has written beside the targets: its folder, and the paths in it."""

    folder: str
    paths: list[str]


class DocumentWriter(DataSourceWriter):
    """Tasks write changed documents beside their targets, the commit moves them there.

    Until all tasks are done no target is touched. Moves are one by one, so if
    the driver ends amid them each document is the old or the new one as a
    whole, and running the job again does the rest. Every attempt of a task has
    a folder of its own; those of attempts that failed go with the commit or
    the abort. What the driver holds are the paths of changed documents.
    """

    def __init__(self, root: str, fields: list[str]):
        self.root, self.at = root, (fields.index("path"), fields.index("doc"))
        self.job = f"{WAITING}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Waiting:
        system, base = open_root(self.root)
        done, folder = [], f"{base}/{self.job}/{uuid.uuid4().hex}"
        for row in iterator:
            path, doc = (row[i] for i in self.at)
            if doc is None:
                continue
            target, new = f"{base}/{safe(path)}", shown(doc)
            info = system.get_file_info(target)
            if info.type == fs.FileType.File and info.size == len(new):
                with system.open_input_stream(target) as f:
                    if f.read() == new:
                        continue
            beside = f"{folder}/{path}"
            system.create_dir(beside.rpartition("/")[0], recursive=True)
            with system.open_output_stream(beside) as f:
                f.write(new)
            done.append(path)
        return Waiting(folder, done)

    def commit(self, messages: list) -> None:
        system, base = open_root(self.root)
        written = [m for m in messages if m is not None]
        seen: set[str] = set()
        for m in written:
            if len(set(m.paths)) < len(m.paths) or not seen.isdisjoint(m.paths):
                self.abort(messages)
                raise ValueError("several changed documents have one path")
            seen.update(m.paths)
        for m in written:
            for path in m.paths:
                system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                system.move(f"{m.folder}/{path}", f"{base}/{path}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Nothing that waited stays."""
        system, base = open_root(self.root)
        if system.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")
        top = f"{base}/{WAITING}"
        if system.get_file_info(top).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(top)):
            system.delete_dir(top)


class JsonDocuments(DataSource):
    """Rows with the columns path and doc; null docs, as rejected ones are, are not written. Other columns do not matter."""

    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def schema(self) -> str:
        return "path string, doc string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if overwrite:
            raise ValueError("documents are changed one by one: use the mode append")
        return DocumentWriter(self.options["root"], schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonDocuments)
