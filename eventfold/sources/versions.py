"""Versioned tables: files under one root, and manifests that name them.

A writer first writes new files, then publishes a manifest that lists every
file of the new version. The manifest is one file, which Spark's commit renames
into place: a reader sees the version before or the whole version after, never
a part of one. A version number can be published once; the later of two writers
fails. Files of earlier versions stay until ``vacuum`` removes them.

The driver handles file names only, as Spark does to plan a scan of them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.sources.ndjson import file_system

MANIFEST = "part string, file string, tag bigint"


def _inner(file: str) -> str:
    """A file's name within its file system."""
    return file_system(file)[1]


@dataclass(frozen=True)
class Version:
    number: int
    tag: int  # what the writer says of the version, such as the last micro-batch
    files: dict[str, tuple[str, ...]] = field(default_factory=dict)


class Versions:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def create(self) -> Version:
        return self.publish(Version(0, -1))

    def current(self) -> Version:
        rows = self.spark.read.schema(MANIFEST + ", version bigint").parquet(f"{self.root}/versions")
        newest = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()
        files: dict[str, list[str]] = {}
        for r in newest:
            if r["part"] is not None:
                files.setdefault(r["part"], []).append(r["file"])
        return Version(newest[0]["version"], newest[0]["tag"], {p: tuple(sorted(f)) for p, f in files.items()})

    def publish(self, version: Version) -> Version:
        rows = [(p, f, version.tag) for p, files in version.files.items() for f in files] or [(None, None, version.tag)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.root}/versions/version={version.number}")
        return version

    def write(self, part: str, df: DataFrame) -> tuple[str, ...]:
        """Write rows of a part as new files, not yet in any version."""
        path = f"{self.root}/data/{part}/{uuid.uuid4().hex}"
        df.select(*self.schemas[part].fieldNames()).write.parquet(path)
        found = self.spark.read.schema(self.schemas[part]).parquet(path)
        return tuple(unquote(f) for f in found.inputFiles())  # as names, not as URIs: a reader takes %20 for three signs

    def read(self, part: str, version: Version | None = None) -> DataFrame:
        files = (version or self.current()).files.get(part, ())
        reader = self.spark.read.schema(self.schemas[part])
        return reader.parquet(*files) if files else self.spark.createDataFrame([], self.schemas[part])

    def vacuum(self, keep: int = 1, lost: bool = False) -> list[str]:
        """Remove the versions before the last ``keep`` and the files that only they
        name; returns those files. Manifests go first, so no reader finds a version
        whose files are gone; a reader that holds such a version loses it.

        ``lost`` also removes data files that no version ever named: those of
        writers that failed. Only to be used while no writer is at work. Files are
        removed through Arrow's file systems (local, HDFS, object stores); the
        driver handles their names only.
        """
        from pyarrow import fs
        named = self.spark.read.schema(MANIFEST + ", version bigint").parquet(f"{self.root}/versions")
        rows = named.select("version", "file").collect()
        numbers = sorted({r["version"] for r in rows})
        stay = set(numbers[-max(1, keep):])
        held = {_inner(r["file"]) for r in rows if r["file"] is not None and r["version"] in stay}
        gone = {_inner(r["file"]) for r in rows if r["file"] is not None} - held
        system, inner = file_system(self.root)
        for number in numbers:
            if number not in stay:
                system.delete_dir(f"{inner}/versions/version={number}")
        if lost:
            listing = system.get_file_info(fs.FileSelector(f"{inner}/data", recursive=True, allow_not_found=True))
            gone |= {f.path for f in listing if f.type == fs.FileType.File and f.path.endswith(".parquet")} - held
        for file in sorted(gone):
            if system.get_file_info(file).type == fs.FileType.File:  # a run that was interrupted may have removed it
                system.delete_file(file)
        return sorted(gone)

    def next(self, of: Version, tag: int, added: dict[str, tuple[str, ...]], removed: dict[str, set[str]] | None = None) -> Version:
        """Publish ``of`` with files added and removed."""
        removed = removed or {}
        files = {p: tuple(f for f in of.files.get(p, ()) if f not in removed.get(p, ())) + added.get(p, ()) for p in self.schemas}
        return self.publish(Version(of.number + 1, tag, {p: f for p, f in files.items() if f}))
