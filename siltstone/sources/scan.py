"""Directory trees as tables: a Spark data source that lists files and folders.

``spark.read.format("manifest").option("root", "/a").load()`` gives kind, rel_path, abs_path, size, mtime_ns, dev, ino.
Options: ``root`` (required), ``exclude`` (globs separated by line breaks), ``on_error`` (``fail``, the default, or ``skip``).
Top-level folders are listed in parallel; an excluded folder is not entered; links and special files are left out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions.glob import compile_excludes

SCHEMA = "kind string, rel_path string, abs_path string, size bigint, mtime_ns bigint, dev bigint, ino bigint"


class _Folder(InputPartition):
    def __init__(self, rel: str, deep: bool):
        self.rel, self.deep = rel, deep


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ManifestReader(self.options)


class ManifestReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("root"):
            raise ValueError("the option root is required")
        self.root = os.path.abspath(options["root"])
        self.rx = compile_excludes([g for g in (options.get("exclude") or "").split("\n") if g.strip()])
        self.strict = (options.get("on_error") or "fail") == "fail"

    def _excluded(self, rel: str, folder: bool) -> bool:
        low = rel.lower()
        return bool(self.rx) and (bool(re.match(self.rx, low)) or (folder and bool(re.match(self.rx, f"{low}/"))))

    def _entries(self, rel: str) -> list[os.DirEntry]:
        try:
            with os.scandir(os.path.join(self.root, rel)) as found:
                return sorted(found, key=lambda e: e.name)
        except OSError:
            if self.strict:
                raise
            return []

    def partitions(self) -> list[InputPartition]:
        own = [_Folder("", False)]
        return own + [_Folder(e.name, True) for e in self._entries("") if e.is_dir(follow_symlinks=False) and not self._excluded(e.name, True)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if partition.deep:
            yield self._row(partition.rel, "dir")
        waiting = [partition.rel]
        while waiting:
            at = waiting.pop()
            below = []
            for e in self._entries(at):
                rel = f"{at}/{e.name}" if at else e.name
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if partition.deep and not self._excluded(rel, True):
                        yield self._row(rel, "dir")
                        below.append(rel)
                elif e.is_file(follow_symlinks=False) and not self._excluded(rel, False):
                    yield self._row(rel, "file")
            waiting += reversed(below)

    def _row(self, rel: str, kind: str) -> tuple:
        path = os.path.join(self.root, rel)
        s = os.lstat(path)
        return (kind, rel, path, s.st_size if kind == "file" else None, s.st_mtime_ns, s.st_dev, s.st_ino)


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, on_error: str = "fail") -> DataFrame:
    spark.dataSource.register(ManifestSource)
    return spark.read.format("manifest").option("root", root).option("exclude", "\n".join(exclude or [])).option("on_error", on_error).load()


def files_of(listing: DataFrame) -> DataFrame:
    return listing.where("kind = 'file'").drop("kind")


def folders_of(listing: DataFrame) -> DataFrame:
    """Folders below the root, empty ones too."""
    return listing.where("kind = 'dir'").select("rel_path")


def physical_objects(spark: SparkSession, objects_root: str, prefix: str = "h3:") -> DataFrame:
    """object_key, dev, ino of stored objects: files whose name is hexadecimal. A folder that is not there has none."""
    if not os.path.isdir(objects_root):
        return spark.createDataFrame([], "object_key string, dev bigint, ino bigint")
    listing = files_of(scan(spark, objects_root))
    name = F.element_at(F.split("rel_path", "/"), -1)
    return listing.where(name.rlike("^[0-9A-Fa-f]+$")).select(F.concat(F.lit(prefix), name).alias("object_key"), "dev", "ino")
