"""Writers of the index, the search log and training examples."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config


def _wide(t: T.DataType) -> T.DataType:
    """The type with doubles for floats, however nested."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_wide(t.elementType), t.containsNull)
    if isinstance(t, T.MapType):
        return T.MapType(_wide(t.keyType), _wide(t.valueType), t.valueContainsNull)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _wide(f.dataType), f.nullable) for f in t])
    return T.DoubleType() if isinstance(t, T.FloatType) else t


def widened(df: DataFrame) -> DataFrame:
    """Floats as doubles: the shortest text of a float, read as a double, is another number."""
    return df.select(*(F.col(f"`{f.name}`").cast(_wide(f.dataType)).alias(f.name) for f in df.schema))


def as_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without them; numbers read as doubles are those written."""
    df = widened(df)
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.select(*(F.to_json(c).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns))


def write_export(df: DataFrame, path: str, kind: str) -> None:
    """Write as ``json``, ``csv`` or ``parquet``."""
    if kind == "csv":
        as_text(df).write.option("header", True).option("escape", '"').csv(path)
    elif kind in ("json", "parquet"):
        (widened(df) if kind == "json" else df).write.format(kind).save(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def export_index(vectors: DataFrame, path: str, kind: str = "parquet") -> None:
    """The vector table; as text its vectors are JSON."""
    write_export(vectors, path, kind)


def config_table(spark: SparkSession, config: Config = DEFAULT) -> DataFrame:
    """The settings as one row."""
    flat = {k: v if isinstance(v, (int, float, str)) else str(v) for k, v in asdict(config).items()}
    return spark.createDataFrame([tuple(flat.values())], list(flat))


def export_history(history: DataFrame, path: str, kind: str = "json") -> None:
    write_export(history, path, kind)


def append_history(searches: DataFrame, path: str, batch: int | str | None = None) -> None:
    """Append searches to the log, a folder per day.

    With ``batch`` they lie in a folder of that name, which replaces what an earlier
    attempt at the same batch left there, so a repeated append adds nothing; read the log with ``read_history``.
    """
    dated = searches.withColumn("created_date", F.to_date("created_at"))
    if batch is None:
        dated.write.mode("append").partitionBy("created_date").parquet(path)
    else:
        dated.write.mode("overwrite").partitionBy("created_date").parquet(f"{path}/batch={batch}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The log of ``append_history`` with its days; appended batches are one log."""
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def export_examples(examples: DataFrame, path: str) -> None:
    """JSON lines of ``fine_tuning_examples``."""
    examples.select("value").write.text(path)
