"""Hand-over of tables between the steps of an analysis.

A ``Run`` keeps the steps of one analysis in a folder. Each finished step has a line in the manifest: a digest
of what it was made from (its inputs as they are now, the steps before it, its parameters, this package's
code). A run that is started again takes the steps whose digests still hold and makes the others it needs.
"""

from __future__ import annotations

import hashlib
import json
import os
import pathlib
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stage_root(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir.

    Without one, a new local folder where driver and tasks are one process (local mode), else an error:
    executors of a cluster cannot see each other's disks.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("stages need a shared folder: set spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="itspark-")
        context.setCheckpointDir(shared)
    return shared


def new_stage_path(spark: SparkSession, name: str) -> str:
    return os.path.join(stage_root(spark), f"{name}-{uuid.uuid4().hex}")


def write_stage(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write parquet and return the table read back, so that later steps start from the files."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def code_digest() -> str:
    """Of the sources of this package."""
    folder = pathlib.Path(__file__).resolve().parent.parent
    found = hashlib.sha256()
    for file in sorted(folder.rglob("*.py")):
        found.update(f"{file.relative_to(folder)}\0".encode() + file.read_bytes() + b"\0")
    return found.hexdigest()


def input_state(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of each file of an input, which may be a file, a folder or a pattern."""
    place, system = _place(spark, path)
    found = []
    for status in system.globStatus(place) or ():
        files = system.listFiles(status.getPath(), True)
        while files.hasNext():
            file = files.next()
            if not file.getPath().getName().startswith(("_", ".")):
                found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return sorted(found)


class Run:
    """Steps of an analysis in a folder, each made once and only if it is asked for.

    As a context manager it removes the steps that were not to be kept when the analysis has ended, and
    leaves everything where it was when it has failed, so that it can go on. A step that was being written
    when a run ended has no line in the manifest and is made again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.code = code_digest()
        self.steps: dict[str, tuple[str, Callable[[], dict[str, DataFrame]], bool]] = {}
        self.held: dict[str, dict[str, DataFrame]] = {}
        self.made: list[str] = []

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            for name, (_, _, keep) in self.steps.items():
                if not keep:
                    remove(self.spark, self._line(name))
                    remove(self.spark, f"{self.folder}/{name}")

    def _line(self, name: str) -> str:
        return f"{self.folder}/_manifest/{name}.json"

    def _read(self, name: str) -> dict | None:
        place, system = _place(self.spark, self._line(name))
        if not system.exists(place):
            return None
        stream = system.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, line: dict) -> None:
        """Written beside its place and renamed, so that a line is whole or not there."""
        beside, system = _place(self.spark, f"{self.folder}/_manifest/_{name}-{uuid.uuid4().hex}")
        stream = system.create(beside, True)
        try:
            stream.write(json.dumps(line).encode())
        finally:
            stream.close()
        place, _ = _place(self.spark, self._line(name))
        system.delete(place, False)
        if not system.rename(beside, place):
            raise RuntimeError(f"the manifest line of {name} cannot be written")

    def add_tables(
        self, name: str, make: Callable[[], dict[str, DataFrame]], inputs: Sequence[str] = (), after: Sequence[str] = (), params: object = None, keep: bool = True
    ) -> None:
        """A step that makes several tables, in folders below its own.

        ``inputs`` are the paths that it reads, ``after`` the steps that it goes on from, ``params`` whatever
        else decides what it makes. A step that is not kept is removed when the analysis has ended.
        """
        made_from = [name, self.code, repr(params), [input_state(self.spark, p) for p in inputs], [self.steps[a][0] for a in after]]
        self.steps[name] = (hashlib.sha256(json.dumps(made_from).encode()).hexdigest(), make, keep)

    def add(self, name: str, make: Callable[[], DataFrame], **how) -> None:
        """A step that makes one table."""
        self.add_tables(name, lambda: {"": make()}, **how)

    def tables(self, name: str) -> dict[str, DataFrame]:
        """The step's tables, read from the folder; made only if they are not there as they should be."""
        if name not in self.held:
            digest, make, _ = self.steps[name]
            line = self._read(name)
            if line and line["digest"] == digest:
                self.held[name] = {t: self.spark.read.schema(StructType.fromJson(schema)).parquet(f"{self.folder}/{name}/{t}") for t, schema in line["tables"].items()}
            else:
                remove(self.spark, self._line(name))
                remove(self.spark, f"{self.folder}/{name}")
                self.held[name] = {t: write_stage(df, f"{self.folder}/{name}/{t}") for t, df in make().items()}
                self.made.append(name)
                self._write(name, {"digest": digest, "tables": {t: df.schema.jsonValue() for t, df in self.held[name].items()}})
        return self.held[name]

    def table(self, name: str) -> DataFrame:
        """The table of a step that makes one."""
        return self.tables(name)[""]
