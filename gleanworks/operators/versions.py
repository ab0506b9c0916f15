"""A versioned table of the store: whole versions of Parquet, and commits that are taken exclusively.

A change reads the last version, writes the next under a name of its own, and claims the next number by creating its
commit file, which only one writer can. A writer that comes late starts over from what the other one wrote, so
no change is lost, and readers always see a whole version. Marks (a stream's batch number, for one) are carried
from commit to commit; a change whose mark is there already is done.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class NothingHarvested(Exception):
    """A run without rows whose sources failed: the store stays as it is."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))
        self.linked = self._fs.getScheme() == "file"  # commits are hard links; elsewhere renames

    def commits(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.folder}/commits"))
        return sorted(int(x.getPath().getName()) for x in found if x.getPath().getName().isdigit())

    def state(self, number: int | None = None) -> tuple[int, dict]:
        """The last commit's number (0: none), or the given one, and what it says."""
        numbers = [number] if number else self.commits()
        if not numbers:
            return 0, {"data": None, "marks": {}}
        stream = self._fs.open(self._path(f"{self.folder}/commits/{numbers[-1]:020d}"))
        try:
            return numbers[-1], json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, state: dict | None = None) -> DataFrame:
        state = state or self.state()[1]
        if state["data"] is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{state['data']}")

    def _claim(self, number: int, text: str) -> bool:
        """Whether this writer got the number."""
        path = self._path(f"{self.folder}/commits/{number:020d}")
        if self.linked:  # here a create that must be new is only exclusive in the system's own call
            local = urllib.parse.unquote(urllib.parse.urlsplit(self._fs.makeQualified(path).toString()).path)
            part = f"{local}.{uuid.uuid4().hex}.part"
            with open(part, "w") as f:
                f.write(text)
            try:
                os.link(part, local)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        # written aside and renamed: readers see a whole commit or none, and a writer that dies leaves none behind
        part = self._path(f"{self.folder}/commits/.{number:020d}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(kind, 1)
        never[0] = kind.NONE
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(part, path, never)
        except Exception as e:  # noqa: BLE001
            self._fs.delete(part, False)
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> list[str]:
        """Remove the data of versions before the last ``keep`` ones, and what failed writers left. Folders younger than
        ``hours`` stay: a writer may be about to commit them, a reader may read them. The names removed."""
        used = {self.state(n)[1]["data"] for n in self.commits()[-keep:]}
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        removed = []
        for x in self._fs.listStatus(self._path(self.folder)):
            name = x.getPath().getName()
            if name.startswith("data-") and name not in used and now - x.getModificationTime() >= hours * 3_600_000:
                self._fs.delete(x.getPath(), True)
                removed.append(name)
        return sorted(removed)

    def change(self, how: Callable[[DataFrame], DataFrame], mark: tuple[str, int] | None = None, tries: int = 20) -> int:
        """Apply how to the last version and commit the result; the number of the commit that holds it."""
        columns = [c.split()[0] for c in self.schema.split(", ")]
        for _ in range(tries):
            number, state = self.state()
            if mark and state["marks"].get(mark[0], -1) >= mark[1]:
                return number
            name = f"data-{uuid.uuid4().hex}"
            how(self.read(state)).select(*columns).write.parquet(f"{self.folder}/{name}")
            marks = state["marks"] | ({mark[0]: mark[1]} if mark else {})
            if self._claim(number + 1, json.dumps({"data": name, "marks": marks})):
                return number + 1
        raise RuntimeError(f"{tries} other writers were quicker")


def guarded(rows: DataFrame, errors: list[tuple[str, str]]) -> DataFrame:
    """rows, unless a run found none and has errors to blame: then nothing may be written from it."""
    if errors and rows.isEmpty():
        raise NothingHarvested(f"{len(errors)} sources failed: " + ", ".join(f"{s} ({e})" for s, e in errors))
    return rows


def _local(path: str) -> str:
    return urllib.parse.unquote(urllib.parse.urlsplit(path).path) if path.startswith("file:") else path


def write_sheet(rows: DataFrame, path: str) -> None:
    """The store's one CSV for a spreadsheet (a person's list: one file), replaced as a whole."""
    from gleanworks.operators.store import guarded_csv

    spark = rows.sparkSession
    part = f"{path}.{uuid.uuid4().hex}.part"
    guarded_csv(rows).coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(part)
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(part).getFileSystem(spark._jsc.hadoopConfiguration())
    (made,) = (x.getPath() for x in fs.listStatus(where(part)) if x.getPath().getName().endswith(".csv"))
    if fs.getScheme() == "file":
        os.replace(_local(made.toUri().getPath()), _local(path))
    else:
        kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(made, where(path), options)
    fs.delete(where(part), True)
