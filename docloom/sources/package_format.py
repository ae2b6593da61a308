"""Packages as a Spark data source: ``docx_parts``, a row a part, to read with the filter on parts in the scan, and to write whole packages.

Reading and writing go by Python's files, so the path must be a folder that all executors have mounted; packages in other stores are read
by docx.packages(). Register with ``spark.dataSource.register(PackageParts)``; filters reach the scan where
``spark.sql.python.filterPushdown.enabled`` is set.
"""

from __future__ import annotations

import fnmatch
import os
import shutil
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage

SCHEMA = "doc_id string, part string, content binary"
#: Bytes of packages that one task reads, about.
TASK_BYTES = 64 << 20
#: Parts that come first in a package.
FIRST = ("[Content_Types].xml", "_rels/.rels")


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


def _local(path: str) -> str:
    return path.removeprefix("file://")


class PackageParts(DataSource):
    """Options: path, a folder; glob, of file names (``*.docx``)."""

    @classmethod
    def name(cls) -> str:
        return "docx_parts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PartReader(_local(self.options["path"]), self.options.get("glob", "*.docx"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["doc_id", "part", "content"]:
            raise ValueError(f"packages are written from ({SCHEMA})")
        return PackageWriter(_local(self.options["path"]), overwrite)


class PartReader(DataSourceReader):
    """A filter on parts that the scan can decide is taken: equality, membership, beginning and end. Parts that it leaves out are not unpacked."""

    def __init__(self, path: str, glob: str):
        self.path, self.glob = path, glob
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters):  # noqa: N802: the name is Spark's
        for f in filters:
            if isinstance(f, IsNotNull):  # no column of a part is null
                continue
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("part",):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f

    def wanted(self, part: str) -> bool:
        test = {"EqualTo": part.__eq__, "In": lambda v: part in v, "StringStartsWith": part.startswith, "StringEndsWith": part.endswith}
        return all(test[kind](value) for kind, value in self.tests)

    def partitions(self) -> list[Files]:
        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if fnmatch.fnmatch(n, self.glob) and not os.path.basename(d).startswith("_"))
        out, held, size = [], [], 0
        for path in found:
            held.append(path)
            size += os.path.getsize(path)
            if size > TASK_BYTES:
                out.append(Files(tuple(held)))
                held, size = [], 0
        return [*out, Files(tuple(held))] if held or not out else out

    def read(self, partition: Files):
        """A package, or a part of one, that cannot be read gives no row; docx.faults() tells them."""
        for path in partition.paths:
            try:
                package = zipfile.ZipFile(path)
            except (zipfile.BadZipFile, OSError):
                continue
            with package:
                for part in sorted(x for x in package.namelist() if not x.endswith("/") and self.wanted(x)):
                    try:
                        yield os.path.relpath(path, self.path), part, package.read(part)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError):
                        continue


class PackageWriter(DataSourceWriter):
    """Each document's rows must come to one task, as from packages_to_write(). Tasks write into a folder of their own below the target; the
    commit of the job moves the packages out of it, and an abort leaves nothing. A document that is there already is an error, told before
    anything is moved, unless overwrite is asked for."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.stage = os.path.join(path, f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator) -> Written:
        folder = os.path.join(self.stage, uuid.uuid4().hex)  # a task that runs again has another
        names, doc, parts = [], None, {}

        def close() -> None:
            path = os.path.join(folder, doc)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
                for part in sorted(parts, key=lambda x: (x not in FIRST, x)):
                    z.writestr(zipfile.ZipInfo(part), parts[part])
            names.append(doc)

        for row in iterator:
            if row.doc_id != doc:
                if doc is not None:
                    close()
                doc, parts = row.doc_id, {}
                if os.path.isabs(doc) or ".." in doc.split("/"):
                    raise ValueError(f"not a name below the folder: {doc}")
            parts[row.part] = bytes(row.content)
        if doc is not None:
            close()
        return Written(folder, tuple(names))

    def commit(self, messages) -> None:
        try:
            moves = [(os.path.join(m.folder, n), os.path.join(self.path, n)) for m in messages if m for n in m.names]
            twice = len({to for _, to in moves}) != len(moves)
            there = [to for _, to in moves if os.path.exists(to)]
            if twice or (there and not self.overwrite):
                raise FileExistsError(there[0] if there else "a document came to two tasks")
            for source, to in moves:
                os.makedirs(os.path.dirname(to), exist_ok=True)
                os.replace(source, to)
        finally:
            shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


def packages_to_write(parts, changed=None):
    """parts(doc_id, part, content), changed(doc_id, part, content) -> the rows of whole packages, changed parts in place of the old or added, those
    with a null content left out; each document in one task, in order, as the writer asks for."""
    from pyspark.sql import functions as F

    whole = parts
    if changed is not None:
        kept = parts.join(changed.select("doc_id", "part"), ["doc_id", "part"], "left_anti")
        whole = kept.unionByName(changed.where(F.col("content").isNotNull()))
    return whole.select("doc_id", "part", F.col("content").cast("binary").alias("content")).repartition("doc_id").sortWithinPartitions("doc_id", "part")
