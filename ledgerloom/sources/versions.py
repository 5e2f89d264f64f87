"""Builds that readers see whole or not at all.

A build is written to a folder of its own, which nobody looks into before it is
committed. A commit is one small file with the folder's name, numbered in sequence and
put in place by a rename that fails if the number is taken. Readers take the highest
number, so they keep the last committed build while the next one is written, when it
fails halfway, and when two are written at once: of two commits of one number the
second is refused and can be tried again on what the first has published.

Files go through Hadoop's file systems, so a folder can be wherever Spark can write.
Object stores whose rename replaces an existing file need one publisher at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

_COMMITS, _BUILDS, _DIGITS = "_commits", "builds", 12


class CommitConflict(RuntimeError):
    """Another build was committed since this one was begun."""


@dataclass(frozen=True)
class Build:
    """A folder being written, and the commit it follows (0: none)."""

    folder: str
    after: int


class Versions:
    """The builds below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def begin(self) -> Build:
        """A new folder, after the newest commit."""
        return Build(f"{self.root}/{_BUILDS}/{uuid.uuid4().hex}", self.latest())

    def commit(self, build: Build) -> int:
        """Publish ``build``; its number. Refused if another commit came in between."""
        number = build.after + 1
        if number <= self.latest():
            raise CommitConflict(f"commit {number} of {self.root} exists already")
        name = build.folder.rsplit("/", 1)[1]
        draft = self._path(f"{self.root}/{_COMMITS}/.{name}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(name.encode()))
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.makeQualified(draft).toUri(), self._conf
        )
        none = self._jvm.java.lang.reflect.Array.newInstance(
            self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0
        )
        place = self._path(f"{self.root}/{_COMMITS}/{number:0{_DIGITS}d}")
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(place), none)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(place):
                raise CommitConflict(f"commit {number} of {self.root} exists already") from error
            raise
        return number

    def append(self, folder: str) -> int:
        """Commit a folder that does not depend on earlier ones, after whatever is newest."""
        while True:
            try:
                return self.commit(Build(folder, self.latest()))
            except CommitConflict:
                continue

    def numbers(self) -> list[int]:
        """Numbers of all commits, oldest first."""
        folder = self._path(f"{self.root}/{_COMMITS}")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int:
        return max(self.numbers(), default=0)

    def folder(self, number: int | None = None) -> str:
        """The folder of a commit, of the newest one by default."""
        number = self.latest() if number is None else number
        if not number:
            raise LookupError(f"nothing is committed in {self.root}")
        file = self._fs.open(self._path(f"{self.root}/{_COMMITS}/{number:0{_DIGITS}d}"))
        try:
            name = self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()
        return f"{self.root}/{_BUILDS}/{name}"

    def folders(self) -> dict[int, str]:
        """The folder of every commit, oldest first."""
        return {number: self.folder(number) for number in self.numbers()}

    def expire(self, keep: int) -> list[str]:
        """Delete what no reader of the last ``keep`` commits needs: older builds and their commits.

        Folders without a commit stay, since they may be builds in progress.
        """
        if keep < 1:
            raise ValueError("the newest commit cannot expire")
        gone = []
        for number in self.numbers()[:-keep]:
            folder = self.folder(number)
            # The commit first: a reader never finds one whose folder is gone.
            self._fs.delete(self._path(f"{self.root}/{_COMMITS}/{number:0{_DIGITS}d}"), False)
            self._fs.delete(self._path(folder), True)
            gone.append(folder)
        return gone
