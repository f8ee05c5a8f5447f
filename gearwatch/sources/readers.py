"""Readers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearwatch.operators.quality import PanelError, require_columns
from gearwatch.panel import EQUIPMENT, PanelSpec, equipment_schema


def read_panel_csv(spark: SparkSession, path: str, spec: PanelSpec = EQUIPMENT, schema: T.StructType | None = None, delimiter: str = ",") -> DataFrame:
    """CSV panel with a declared schema: columns by header name, text first, then cast.

    A date, flag or number that is present but does not parse is an error, found
    in one aggregate over the raw text; blank cells stay NULL. The header is read
    alone (no inference pass over the data).
    """
    schema = schema or equipment_schema()
    reader = spark.read.option("sep", delimiter).option("encoding", "UTF-8")
    header = reader.option("header", True).option("inferSchema", False).csv(path).columns
    names = [h.lstrip("﻿") for h in header]
    missing = sorted({f.name for f in schema} - set(names))
    if missing:
        raise PanelError(f"missing columns: {missing}")
    # Each file's header is held against these names: a file with another order of columns is an error.
    raw = reader.option("header", True).option("enforceSchema", False).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    typed = raw.select(*[_cast(f).alias(f.name) for f in schema])
    bad = raw.agg(
        *[
            F.count(F.when(F.col(f.name).isNotNull() & _cast(f).isNull(), F.lit(1))).alias(f.name)
            for f in schema
            if not isinstance(f.dataType, T.StringType)
        ],
        F.count(F.when(_cast(schema[spec.flag]).isNull(), F.lit(1))).alias("_flag"),
    ).first().asDict()
    broken = {k: v for k, v in bad.items() if v}
    if broken:
        raise PanelError(f"values that do not parse: {broken}")
    return typed


def _cast(field: T.StructField):
    text = F.trim(F.col(field.name))
    if isinstance(field.dataType, T.DateType):
        return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    if isinstance(field.dataType, T.StringType):
        return F.col(field.name)
    if isinstance(field.dataType, T.IntegerType):
        number = text.try_cast("double")
        whole = number.try_cast("int")
        return F.when(number == whole, whole)
    return text.try_cast(field.dataType)


def read_panel_parquet(spark: SparkSession, path: str, spec: PanelSpec = EQUIPMENT, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet panel; only the named columns are scanned."""
    df = spark.read.parquet(path)
    require_columns(df, columns or spec.required)
    return df.select(*columns) if columns else df


def read_existing(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", path_column: str = "metrics_path") -> DataFrame:
    """Stack the sources that exist, each row with its file; none at all is an error."""
    out = None
    for path in paths:
        try:
            part = spark.read.format(fmt).option("header", True).load(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        part = part.withColumn(path_column, F.input_file_name())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"none of the sources exist: {list(paths)}")
    return out
