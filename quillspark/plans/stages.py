"""Stages of a run as tables: each is written once, under the key of what it was made of, and read again.

A key is a digest of a stage's name, its options and the keys of the stages that it
reads; that of the first stage comes from the rows themselves.  A manifest in the folder
lists finished stages only, so a run that was killed takes up where it stopped, and a run over
the same rows with the same options does nothing but read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from quillspark.operators.lineage import shared_folder

#: Part of every key: raise it when stages come to mean something else.
VERSION = "3"
ENTRY = "key string, stage string, path string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


@dataclass(frozen=True)
class Stage:
    """A finished table and its key."""

    table: DataFrame
    key: str


class Stages:
    """The stages under a folder that driver and executors share; by default one of its own in the checkpoint folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/stages-{uuid.uuid4()}"
        path = f"{self.folder}/manifest"  # a row a stage of the folder's runs
        self.paths = {r["key"]: r["path"] for r in spark.read.schema(ENTRY).json(path).collect() if r["key"]} if exists(spark, path) else {}

    def _finished(self, name: str, key: str, path: str) -> Stage:
        self.paths[key] = path
        self.spark.createDataFrame([(key, name, path)], ENTRY).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        return Stage(self.spark.read.parquet(path), key)

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4()}"

    @staticmethod
    def _key(*parts: object) -> str:
        return sha256(repr((VERSION, *parts)).encode()).hexdigest()

    def first(self, name: str, rows: DataFrame, change: Callable[[DataFrame], DataFrame], *options: object) -> Stage:
        """The first stage, ``change`` of ``rows``: these are read once, and hashed on their way into it."""
        seen, path = Observation(), self._path(name)
        mixed = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.sum(F.crc32(F.to_json(F.struct(*rows.columns)).cast("binary")).cast("decimal(38,0)"))
        change(rows.observe(seen, F.count(F.lit(1)).alias("n"), *(m.alias(f"m{k}") for k, m in enumerate(mixed)))).write.parquet(path)
        key = self._key(name, options, rows.columns, sorted((k, str(v)) for k, v in seen.get.items()))
        done = self.paths.get(key)
        return Stage(self.spark.read.parquet(done), key) if done else self._finished(name, key, path)

    def then(self, name: str, made_of: list[Stage], make: Callable[..., DataFrame], *options: object) -> Stage:
        """A later stage: ``make`` of the tables of others."""
        key = self._key(name, options, [s.key for s in made_of])
        if done := self.paths.get(key):
            return Stage(self.spark.read.parquet(done), key)
        path = self._path(name)
        make(*(s.table for s in made_of)).write.parquet(path)
        return self._finished(name, key, path)
