"""Tables in a shared folder that change as a whole or not at all.

Every write goes to a folder of its own, an attempt. Numbered manifests say which attempt
holds each part (a zone, a level, or the whole table) and how many bytes it has. A write
counts from the moment its manifest has its final name, which one writer alone can take;
whoever comes second takes the next number, over what the first has said. Readers follow
one manifest, so they see a whole state, also while others write.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Mapping
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part -> (attempt that holds it, its bytes).
Parts = dict[str, tuple[str, int]]

_STATUS = re.compile(r"path=(.*?); isDirectory=false; length=(\d+);.*?modification_time=(\d+);")


class Folder:
    """Names and sizes in the shared file system, through Hadoop so any scheme works."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def child(self, name: str) -> "Folder":
        return Folder(self.spark, f"{self.path}/{name}")

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path)] if self.exists() else []

    def states(self) -> dict[str, str]:
        """Length and time of change of each file, from one listing."""
        iterators = self.spark._jvm.org.apache.hadoop.util.functional.RemoteIterators
        listed = iterators.toList(self._fs.listStatusIterator(self._path)).toString()
        return {path.rpartition("/")[2]: f"{length} {time}" for path, length, time in _STATUS.findall(listed)}

    def sizes(self) -> dict[str, int]:
        """Bytes per sub-folder holding data; of all files as ``files`` where there is none."""
        out: dict[str, int] = {}
        if not self.exists():
            return out
        for status in self._fs.listStatus(self._path):
            name = status.getPath().getName()
            if not name.startswith(("_", ".")):
                part = name if status.isDirectory() else "files"
                out[part] = out.get(part, 0) + self._fs.getContentSummary(status.getPath()).getLength()
        return out

    def read_text(self) -> str:
        stream = self._fs.open(self._path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str) -> bool:
        """Bring a file about with all of its text at once; False if it was there before."""
        draft = self._path.getParent().suffix(f"/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                self._fs.getUri(), self.spark._jsc.hadoopConfiguration()
            ).rename(draft, self._path, options)
            return True
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
                return False
            raise

    def remove(self) -> None:
        self._fs.delete(self._path, True)


def file_states(spark: SparkSession, files: Iterable[str]) -> list[str]:
    """Path, length and time of change of data files, by one listing for each folder."""
    by_folder: dict[str, list[str]] = {}
    for file in files:
        folder, _, name = file.rpartition("/")
        by_folder.setdefault(folder, []).append(unquote(name))
    out = []
    for folder, names in by_folder.items():
        there = Folder(spark, unquote(folder)).states()
        out += [f"{folder}/{name} {there[name]}" for name in names]
    return sorted(out)


class VersionedTable:
    """A Parquet table of attempts and manifests below one folder, by ``partition`` if given."""

    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self._manifests = Folder(spark, f"{self.path}/manifests")

    def _latest(self) -> tuple[int, Parts]:
        numbers = [int(n) for n in self._manifests.names() if n.isdigit()]
        if not numbers:
            return 0, {}
        text = self._manifests.child(f"{max(numbers):010d}").read_text()
        return max(numbers), {k: (a, b) for k, (a, b) in json.loads(text).items()}

    def parts(self) -> Parts:
        """What the newest manifest says is there."""
        return self._latest()[1]

    def intact(self) -> Parts:
        """The parts whose attempt still has the bytes that the manifest says."""
        said = self.parts()
        there = {a: Folder(self.spark, f"{self.path}/{a}").sizes() for a in {a for a, _ in said.values()}}
        return {k: (a, b) for k, (a, b) in said.items() if there[a].get(k, 0) == b}

    def write(self, df: DataFrame) -> Parts:
        """A new attempt with the rows of ``df``; nobody sees it before it is committed."""
        attempt = f"attempt-{uuid.uuid4().hex}"
        rows = df.hint("rebalance", F.col(self.partition)) if self.partition else df
        writer = rows.write.partitionBy(self.partition) if self.partition else rows.write
        writer.parquet(f"{self.path}/{attempt}")
        return {k: (attempt, b) for k, b in Folder(self.spark, f"{self.path}/{attempt}").sizes().items()}

    def commit(self, change: Callable[[Parts], Mapping[str, tuple[str, int]]]) -> Parts:
        """Replace the newest manifest by what ``change`` makes of it, over again while
        another writer comes first. Returns what now holds."""
        while True:
            number, now = self._latest()
            new = dict(change(dict(now)))
            if new == now:
                return now
            if self._manifests.child(f"{number + 1:010d}").create(json.dumps(new, sort_keys=True)):
                return new

    def read(self, parts: Parts | None = None) -> DataFrame:
        """The rows of one manifest, that of now if none is given."""
        parts = self.parts() if parts is None else parts
        held: dict[str, list[str]] = {}
        for name, (attempt, size) in parts.items():
            if size:
                held.setdefault(attempt, []).append(name)
        if not held:
            raise FileNotFoundError(f"nothing is committed in {self.path}")
        out = None
        for attempt, names in sorted(held.items()):
            folder = f"{self.path}/{attempt}"
            rows = self.spark.read.parquet(folder)
            if self.partition and set(names) != set(Folder(self.spark, folder).sizes()):
                values = [unquote(n.partition("=")[2]) for n in names]
                rows = rows.filter(F.col(self.partition).cast("string").isin(values))
            out = rows if out is None else out.unionByName(rows)
        return out

    def sweep(self) -> None:
        """Remove attempts that the newest manifest has no part of, for when no reader of an
        earlier state and no other writer is left."""
        used = {a for a, _ in self.parts().values()}
        folder = Folder(self.spark, self.path)
        for name in folder.names():
            if name.startswith("attempt-") and name not in used:
                folder.child(name).remove()

    def remove(self) -> None:
        Folder(self.spark, self.path).remove()
