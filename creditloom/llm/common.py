"""Reading, keys and registration shared by the operators of this package."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.sources.tables import passing_tables, stage

__all__ = ["ORACLES", "QUERIES", "fresh", "partitions_for", "passing_tables", "query", "read", "row_key", "row_keys", "stage", "text_size"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this package; see ``plans.catalog.query``."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of 64 bits of a document row that never is null: equal rows share it.

    Rows of large corpora that are not equal may share it too; ``row_keys`` tells these apart.
    """
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(text).isNull())


def row_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two keys of different seeds: together they name a row's id and text."""
    return row_key(doc_id, text), F.xxhash64(F.lit("second"), F.col(text).isNull(), F.col(text), F.col(doc_id))


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one pass over one column."""
    return docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0


def partitions_for(spark: SparkSession, n_bytes: float, each: int = 32 << 20) -> int:
    """Partitions that hold about ``each`` bytes, and no fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / each), 1)
