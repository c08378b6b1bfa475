"""Saving and loading fitted objects.

A saved object is a folder: ``options`` (one row of JSON: kind and settings) and ``parameters``
(section, name, values) as Parquet, and sub-folders for tables and Spark ML models that
belong to it. Everything is written and read by Spark, so any store that Spark reaches will do.
Saving follows Spark ML: ``x.save(path)``, ``x.write().overwrite().save(path)``, ``Kind.load(path)``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml.util import MLReader, MLWriter
from pyspark.sql import SparkSession

_PARAMETERS = "section string, name string, values array<double>"


class StateWriter(MLWriter):
    def __init__(self, owner: Savable):
        super().__init__()
        self.owner = owner

    def saveImpl(self, path: str) -> None:
        self.owner.save_state(self.sparkSession, path.rstrip("/"))


class StateReader(MLReader):
    def __init__(self, kind: type[Savable]):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        return self.kind.load_state(self.sparkSession, path.rstrip("/"))


class Savable:
    """Adds Spark ML's saving and loading to a class with ``save_state`` and ``load_state``."""

    def write(self) -> StateWriter:
        return StateWriter(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls) -> StateReader:
        return StateReader(cls)

    @classmethod
    def load(cls, path: str):
        return cls.read().load(path)

    def save_state(self, spark: SparkSession, path: str) -> None:
        raise NotImplementedError

    @classmethod
    def load_state(cls, spark: SparkSession, path: str):
        raise NotImplementedError


def put_options(spark: SparkSession, path: str, kind: str, options: Mapping) -> None:
    spark.createDataFrame([(kind, json.dumps(options))], "kind string, options string").coalesce(1).write.parquet(f"{path}/options")


def get_options(spark: SparkSession, path: str, *kinds: str) -> tuple[str, dict]:
    row = spark.read.parquet(f"{path}/options").first()
    if row["kind"] not in kinds:
        raise ValueError(f"{path} holds a {row['kind']}, not a {' or '.join(kinds)}")
    return row["kind"], json.loads(row["options"])


def put_parameters(spark: SparkSession, path: str, sections: Mapping[str, Mapping[str, Sequence[float]]]) -> None:
    rows = [(section, name, [float(v) for v in values]) for section, named in sections.items() for name, values in named.items()]
    spark.createDataFrame(rows, _PARAMETERS).coalesce(1).write.parquet(f"{path}/parameters")


def get_parameters(spark: SparkSession, path: str) -> dict[str, dict[str, list[float]]]:
    """Sections of a fitted object: one row a feature, as many as it was fitted on."""
    out: dict[str, dict[str, list[float]]] = {}
    for r in spark.read.schema(_PARAMETERS).parquet(f"{path}/parameters").collect():
        out.setdefault(r["section"], {})[r["name"]] = list(r["values"])
    return out
