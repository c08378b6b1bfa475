"""Reading, checking, writing and staging of tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom import schema as S
from creditloom.functions import columns as C


#: Files that the rows of one prediction partition are dealt to, at most.
FILES_PER_PARTITION = 64


class SchemaError(ValueError):
    """Raised when required columns are absent."""


def validate_schema(df: DataFrame, required: Iterable[str] = S.REQUIRED) -> DataFrame:
    """Presence check on metadata only; runs no job. Extra columns are fine."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise SchemaError(f"missing required columns: {missing}")
    return df


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, so aggregates skip it."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[C.nan_to_null(f"`{c}`").alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns]
    )


def application_schema() -> T.StructType:
    """Explicit types for text input: no inference pass over the data."""
    whole = {S.TARGET}
    fields = [T.StructField(S.ID, T.StringType())]
    for name in S.REQUIRED:
        fields.append(T.StructField(name, T.IntegerType() if name in whole else T.DoubleType()))
    return T.StructType(fields)


def read_table(
    spark: SparkSession,
    path: str,
    required: Iterable[str] | None = S.REQUIRED,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet or CSV by suffix. A missing path fails in Spark's own resolution.

    CSV columns are matched by header name: the header line is read on its own,
    then ``schema`` (default: the application schema) supplies the types and
    any further column is read as text.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    elif suffix == ".csv":
        header = spark.read.option("header", True).csv(path).columns
        known = {f.name: f.dataType for f in (schema or application_schema()).fields}
        typed = T.StructType([T.StructField(h, known.get(h, T.StringType())) for h in header])
        df = spark.read.option("header", True).schema(typed).csv(path)
    else:
        raise ValueError(f"unsupported file suffix: {suffix or path!r}")
    if required is not None:
        validate_schema(df, required)
    return normalise_missing(df)


def table_summary(df: DataFrame, label: str = S.TARGET) -> DataFrame:
    """Row count and default rate, the numbers reported after a load."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(F.col(label).cast("double")), 6).alias("default_rate"),
    )


def write_table(df: DataFrame, path: str, formats: Iterable[str] = ("parquet", "csv")) -> dict[str, str]:
    """Write the same table in each format under ``path``; returns the locations."""
    written = {}
    for fmt in formats:
        target = f"{path.rstrip('/')}/applications.{fmt}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(target)
        else:
            writer.format(fmt).save(target)
        written[fmt] = target
    return written


def write_predictions(
    scored: DataFrame, reports: Mapping[str, DataFrame], path: str, model: str = "model", period: str | None = None
) -> dict[str, str]:
    """Scored rows partitioned by model (and period), plus one table per report.

    Only the partitions that ``scored`` has rows for are replaced: a rerun of one model
    or month leaves the files of the others as they are. Reports are replaced whole.
    """
    root = path.rstrip("/")
    out = {"predictions": f"{root}/predictions"}
    parts = [model, *([period] if period else [])]
    # Rows of one partition come together, so that each is a few files and not one a task.
    dealt = scored.repartition(*parts, F.pmod(F.xxhash64(*[c for c in scored.columns if c not in parts]), F.lit(FILES_PER_PARTITION)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(out["predictions"])
    for name, report in reports.items():
        out[name] = f"{root}/tables/{name}"
        report.write.mode("overwrite").parquet(out[name])
    return out


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    Only a local session without the setting gets a folder of its own; on a
    cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="creditloom-")
        named = _local_folders[app]
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a derived table once to the shared folder and read it back.

    For tables that several passes read: lineage is cut by durable files, so a
    lost executor costs a re-read and no recomputation. Inside ``passing_tables``
    the table goes at the end, unless ``keep`` is set.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made = _passing.get()
    if made is not None and not keep:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end: what is returned from it must be staged with ``keep``."""
    made: list[str] = []
    token = _passing.set(made)
    try:
        yield
    finally:
        _passing.reset(token)
        for name in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
