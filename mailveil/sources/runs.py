"""Output that appears as a whole: written aside, then published by one rename."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    """The file system that holds a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder, none if it does not exist."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))
                      if s.isDirectory())

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def rename(self, source: str, target: str) -> None:
        if not self.fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        source = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()


# Names that start with an underscore are skipped by Spark's readers.
STAGED, PUBLISHED, MANIFEST = "_staged-", "run-", "_manifest.json"


def stage_folder(path: str, run: str) -> str:
    return f"{path}/{STAGED}{run}"


def publish(spark: SparkSession, path: str, run: str, manifest: dict) -> None:
    """Publish what stands in the staging folder of a run, unless that is done already.

    The manifest goes in first, so a published run always has one.
    """
    files, target = Files(spark, path), f"{path}/{PUBLISHED}{run}"
    if files.exists(target):
        return
    files.write(f"{stage_folder(path, run)}/{MANIFEST}", json.dumps({"run": run} | manifest))
    files.rename(stage_folder(path, run), target)


def published(spark: SparkSession, path: str) -> list[dict]:
    """The manifests of all published runs."""
    files = Files(spark, path)
    found = (f"{path}/{name}/{MANIFEST}" for name in files.folders(path)
             if name.startswith(PUBLISHED))
    return [json.loads(files.read(name)) for name in found if files.exists(name)]


def drop_unpublished(spark: SparkSession, path: str) -> None:
    """Remove what runs that never ended have left."""
    files = Files(spark, path)
    for name in files.folders(path):
        if name.startswith(STAGED):
            files.remove(f"{path}/{name}")


def move_in(spark: SparkSession, staged: str, target: str) -> None:
    """Put a written folder in the place of another; nothing if it has been moved before."""
    files = Files(spark, target)
    if files.exists(staged):
        files.remove(target)
        files.rename(staged, target)
