"""Run history: one JSON object per line, or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logcompact import schemas


def read_history(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """History rows; blank and invalid lines are skipped, absent flags are false."""
    reader = spark.read.schema(schemas.HISTORY)
    rows = reader.option("mode", "DROPMALFORMED").json(path) if fmt == "json" else reader.format(fmt).load(path)
    return defaults(rows)


def defaults(rows: DataFrame) -> DataFrame:
    """Absent numbers are zero, absent texts empty, absent flags false."""
    kinds = {T.StringType: "", T.BooleanType: False, T.LongType: 0, T.DoubleType: 0.0}
    filled = {
        f.name: F.coalesce(F.col(f.name), F.lit(kinds[type(f.dataType)]).cast(f.dataType))
        for f in rows.schema.fields
        if type(f.dataType) in kinds
    }
    return rows.withColumns(filled)
