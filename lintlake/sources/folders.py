"""Data source for the files below a folder, empty ones included, as a batch or a stream.

The planner looks at the upper folders only, at most ``WIDE`` names of one at a time, until it
has enough parts; tasks list what lies below and read it. So neither names nor contents pass
the driver. A folder with more names than that is dealt out: each of its tasks goes through
the names and takes its share by a hash of the name.

A stream's offset is a time. A batch holds the files whose status last changed after the one
offset and up to the next, so moved, copied and empty files are seen, each in one batch, also
when a batch is run again; a file that is changed later is seen again.
"""

from __future__ import annotations

import fnmatch
import os
import re
import sys
import time
import zlib
from collections import deque
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Workers get this module's classes by value, so that they need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "lintlake_folder"
WIDE = 1000
BATCH_BYTES, BATCH_FILES = 8 << 20, 500
_SCHEMA = pa.schema([("path", pa.string()), ("content", pa.binary())])


@dataclass
class Part(InputPartition):
    """What one task lists: a folder, its own files only or all below, and a share of its names."""

    folder: str
    below: bool = True
    share: int = 0
    shares: int = 1
    after: int | None = None
    until: int | None = None


class _Local:
    """A local or mounted folder, listed name by name. Links to folders are not followed."""

    def __init__(self, root: str):
        self.root = os.path.abspath(re.sub(r"^file:(?://[^/]*)?", "", root))

    def entries(self, folder: str):
        with os.scandir(os.path.join(self.root, folder)) as found:
            for entry in found:
                yield entry.name, entry.is_dir(follow_symlinks=False), entry

    def is_file(self, entry) -> bool:
        return entry.is_file()

    def changed(self, entry) -> int:
        return entry.stat().st_ctime_ns

    def read(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as file:
            return file.read()

    def write(self, path: str, content: bytes):
        whole = os.path.join(self.root, path)
        os.makedirs(os.path.dirname(whole), exist_ok=True)
        with open(whole, "wb") as file:
            file.write(content)


class _Remote:
    """A folder of a file system that the Arrow library knows by its address."""

    def __init__(self, root: str):
        self.system, self.root = fs.FileSystem.from_uri(root)

    def _whole(self, path: str) -> str:
        return f"{self.root.rstrip('/')}/{path}" if path else self.root

    def entries(self, folder: str):
        for info in self.system.get_file_info(fs.FileSelector(self._whole(folder))):
            yield info.base_name, info.type == fs.FileType.Directory, info

    def is_file(self, info) -> bool:
        return info.type == fs.FileType.File

    def changed(self, info) -> int:
        return info.mtime_ns

    def read(self, path: str) -> bytes:
        with self.system.open_input_stream(self._whole(path)) as file:
            return file.read()

    def write(self, path: str, content: bytes):
        self.system.create_dir(os.path.dirname(self._whole(path)))
        with self.system.open_output_stream(self._whole(path)) as file:
            file.write(content)


def _tree(root: str):
    return _Remote(root) if re.match(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]*://", root) else _Local(root)


def _join(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def _parts(root: str, wanted: int) -> list[Part]:
    """At least ``wanted`` parts where the folders allow it, upper folders opened first."""
    tree, parts, closed = _tree(root), [], deque([""])
    while closed and len(parts) + len(closed) < wanted:
        folder = closed.popleft()
        held = list(islice(((name, is_folder) for name, is_folder, _ in tree.entries(folder)), WIDE + 1))
        if len(held) > WIDE:
            parts += [Part(folder, True, share, wanted) for share in range(wanted)]
            continue
        if not all(is_folder for _, is_folder in held):
            parts.append(Part(folder, False))
        closed += sorted(_join(folder, name) for name, is_folder in held if is_folder)
    return parts + [Part(folder) for folder in closed]


def _files(tree, part: Part, glob: str | None):
    """Paths of a part's files, depth first, one folder after the other."""
    folders = [part.folder]
    while folders:
        folder = folders.pop()
        at_top = folder == part.folder
        for name, is_folder, entry in tree.entries(folder):
            if at_top and zlib.crc32(os.fsencode(name)) % part.shares != part.share:
                continue
            if is_folder:
                if part.below:
                    folders.append(_join(folder, name))
            elif (not glob or fnmatch.fnmatchcase(name, glob)) and tree.is_file(entry):
                if part.after is None or part.after < tree.changed(entry) <= part.until:
                    yield _join(folder, name)


def _batches(root: str, part: Part, glob: str | None):
    tree, held, size = _tree(root), [], 0
    for path in _files(tree, part, glob):
        content = tree.read(path)
        # Names that are no UTF-8 are told apart by the bytes that are not.
        held.append((os.fsencode(path).decode("utf-8", "backslashreplace"), content))
        size += len(content)
        if size >= BATCH_BYTES or len(held) >= BATCH_FILES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held) -> pa.RecordBatch:
    columns = [pa.array(column, field.type) for column, field in zip(zip(*held), _SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob")
        self.wanted = int(options["parts"])

    def partitions(self):
        return _parts(self.root, self.wanted)

    def read(self, partition: Part):
        return _batches(self.root, partition, self.glob)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.batch, self.settle = _Reader(options), float(options["settle"])

    def initialOffset(self):
        return {"changed": 0}

    def latestOffset(self):
        return {"changed": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict):
        parts = self.batch.partitions()
        for part in parts:
            part.after, part.until = start["changed"], end["changed"]
        return parts

    def read(self, partition: Part):
        return self.batch.read(partition)

    def commit(self, end: dict):
        pass


class FolderSource(DataSource):
    """Options: ``path``, ``glob`` over file names, ``parts`` and, of a stream, ``settle`` seconds."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return "path string, content binary"

    def reader(self, schema):
        return _Reader(dict(self.options))

    def streamReader(self, schema):
        return _StreamReader(dict(self.options))


def configured(spark: SparkSession, reader, root: str, glob: str | None, parts: int | None, **options):
    """A batch or stream reader with the source's options."""
    spark.dataSource.register(FolderSource)
    options |= {"path": root, "parts": parts or 4 * spark.sparkContext.defaultParallelism}
    if glob:
        options["glob"] = glob
    return reader.format(NAME).options(**options)


def write_files(files: DataFrame, root: str) -> int:
    """Write ``(path, content)`` rows as files below a folder all executors share; returns how many.

    A task that is run again writes the same files again. Paths must differ and stay below the folder.
    """

    def written(batches):
        tree = _tree(root)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                if os.path.isabs(path) or ".." in path.split("/"):
                    raise ValueError(f"not below the folder: {path}")
                tree.write(path, (content or "").encode())
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    done = files.select("path", "content").mapInArrow(written, "files bigint")
    return done.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files")).first().files
