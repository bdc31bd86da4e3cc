"""Publishing tables as versions: written aside, checked, then made current in one step.

Each change of the current version adds a numbered pointer file; the largest number counts. Nothing that a
reader may be looking at is replaced, so a crash at any point leaves the old version or the new one current.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, SCHEMA_VERSION = "_current-", 3


class Folder:
    """A folder in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm, self.gateway = path.rstrip("/"), spark._jvm, spark.sparkContext._gateway
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.at(""))] if self.fs.exists(self.at("")) else []

    def create(self, name: str, text: str) -> bool:
        """Makes a small file as a whole; False if another writer made it first. Of writers that race, one succeeds.

        The text is written aside and then given its name by what the file system does in one step and only where the name
        is free: a hard link on local disks, elsewhere a rename that doesn't overwrite (stores without renames make it as
        atomic as their own client does).
        """
        aside, to = self.at(f".{name}.{uuid.uuid4().hex}"), self.at(name)
        stream = self.fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getScheme() == "file":
                local = [self.jvm.java.nio.file.Path.of(self.fs.makeQualified(x).toUri()) for x in (to, aside)]
                self.jvm.java.nio.file.Files.createLink(*local)
            else:
                none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                kinds = self.gateway.new_array(none.getClass(), 1)
                kinds[0] = none
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(aside, to, kinds)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.fs.delete(aside, False)
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def publish(df: DataFrame, path: str, *, expected: int | None = None, keep: int = 2, write: Callable[[DataFrame, str], dict] | None = None, **about: object) -> dict:
    """Writes df as a new version and makes it current if its row count is right; else the old one stays.

    write: how df is laid out in the version's folder, as Parquet if not given; returns what to tell about it.
    """
    spark, folder = df.sparkSession, Folder(df.sparkSession, path)
    old = current(spark, path)
    version = f"v{(old or {}).get('number', 0) + 1:06d}-{uuid.uuid4().hex[:8]}"
    at = f"{folder.path}/{version}"
    if write:
        about |= write(df, at)
    else:
        df.write.parquet(at)
    n = spark.read.parquet(at).count()
    if expected is not None and n != expected:
        folder.delete(version)
        raise ValueError(f"{n} rows were written, {expected} were expected; the current version stays")
    meta = {"version": version, "number": (old or {}).get("number", 0) + 1, "rows": n, "schema_version": SCHEMA_VERSION, "built_at_utc": datetime.now(UTC).isoformat(), "previous": ([old["version"], *old["previous"]] if old else [])[:keep]} | about
    point(folder, meta)
    for gone in ([old["version"], *old["previous"]] if old else [])[keep:]:
        folder.delete(gone)
    return meta


def point(folder: Folder, meta: dict) -> None:
    """Makes meta's version current; pointers older than those kept go."""
    if not folder.create(f"{POINTER}{meta['number']:09d}", json.dumps(meta)):
        raise OSError(f"another writer published number {meta['number']} of {folder.path}")
    for name in sorted(x for x in folder.names() if x.startswith(POINTER))[:-3]:
        folder.delete(name)


def current(spark: SparkSession, path: str) -> dict | None:
    """What the current version says about itself; None if nothing is published."""
    folder = Folder(spark, path)
    names = sorted(x for x in folder.names() if x.startswith(POINTER))
    return json.loads(folder.read(names[-1])) if names else None


def load(spark: SparkSession, path: str, *, model: str | None = None) -> DataFrame | None:
    """The current version; None if there is none. model: the embedding model that it must be built with."""
    meta = current(spark, path)
    if meta is None:
        return None
    if model is not None and meta.get("embedding_model") != model:
        raise ValueError(f"the index was built with {meta.get('embedding_model')!r}, not {model!r}")
    return spark.read.parquet(f"{path.rstrip('/')}/{meta['version']}")


def roll_back(spark: SparkSession, path: str) -> dict:
    """Makes the previous version current again."""
    meta = current(spark, path)
    if not meta or not meta["previous"]:
        raise ValueError("there is no previous version")
    back = meta | {"version": meta["previous"][0], "previous": meta["previous"][1:], "number": meta["number"] + 1}
    back["rows"] = spark.read.parquet(f"{path.rstrip('/')}/{back['version']}").count()
    point(Folder(spark, path), back)
    return back


def health(spark: SparkSession, path: str) -> DataFrame:
    """One row on an index: whether it is there, its rows, version and model."""
    meta = current(spark, path) or {}
    return spark.range(1).select(F.lit(bool(meta)).alias("ready"), F.lit(meta.get("rows")).cast("long").alias("rows"), F.lit(meta.get("version")).cast("string").alias("version"), F.lit(meta.get("embedding_model")).cast("string").alias("embedding_model"))
