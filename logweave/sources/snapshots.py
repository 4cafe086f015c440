"""Numbered snapshots of what a table consists of, by compare-and-set on the file system.

A snapshot is a small JSON file. Its successor is created only if nobody else has created it before, so of two writers
that start from the same snapshot one has to begin anew from the other's. Everything else that a snapshot names is
written once under a fresh name, so nothing that a reader of an older snapshot sees is ever changed.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Times that a change is tried against other writers.
TRIES = 200


class Conflict(Exception):
    """Others have published changes that this one cannot be put on top of."""


class Files:
    """What is needed of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf, self.root = spark.sparkContext._jsc.hadoopConfiguration(), root
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def listed(self, name: str) -> list[tuple[str, float]]:
        """Names in a folder and the seconds since 1970 of their last change; a folder that is not there is empty."""
        if not self.exists(name):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self.path(name))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def create(self, name: str, text: str) -> bool:
        """Create a file with its whole text unless there is one; exactly one of several callers does so.

        Local files are linked, others renamed without overwriting, both of which fail where the name is taken.
        """
        part = f"{name}.{uuid.uuid4().hex}.part"
        self.write(part, text)
        try:
            if self.fs.getScheme() == "file":
                local = lambda n: self.fs.makeQualified(self.path(n)).toUri().getPath()
                try:
                    os.link(local(part), local(name))
                except FileExistsError:
                    return False
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
            none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                context.rename(self.path(part), self.path(name), none)
            except Exception as e:
                if self.exists(name):
                    return False
                raise e
            return True
        finally:
            self.delete(part)


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.files = Files(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self.files.listed("_snapshots") if n.endswith(".json"))

    def at(self, version: int) -> dict:
        return json.loads(self.files.read(f"_snapshots/{version:020d}.json"))

    def latest(self) -> tuple[int, dict]:
        """Version and content of the newest snapshot; -1 and nothing before the first."""
        versions = self.versions()
        return (versions[-1], self.at(versions[-1])) if versions else (-1, {})

    def change(self, put: Callable[[dict], dict | None]) -> int:
        """Publish what ``put`` makes of the newest snapshot; anew from the next one as long as others come first.

        ``put`` may be called several times; it returns None if nothing is left to do and raises Conflict if it cannot go on.
        """
        for attempt in range(TRIES):
            version, seen = self.latest()
            new = put(seen)
            if new is None:
                return version
            if self.files.create(f"_snapshots/{version + 1:020d}.json", json.dumps(new)):
                return version + 1
            time.sleep(min(0.5, 0.005 * attempt))
        raise Conflict(f"{TRIES} other changes came first")
