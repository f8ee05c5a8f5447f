"""Sinks: pinned columns, exports, manifests. All of them write from the tasks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearwatch.functions.expressions import display


def write_table(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table with a pinned column order; the commit protocol makes the swap safe against failed tasks."""
    writer = df.select(*columns).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("encoding", "UTF-8")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def bom_header(df: DataFrame) -> DataFrame:
    """First column named with a byte-order mark, so spreadsheet programs read the CSV as UTF-8."""
    return df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])


_POINTERS = "number long, version string"


def replace_table(df: DataFrame, path: str) -> str:
    """Write a new version of a table beside the others, then point to it; the version's name.

    The pointer is one row of one file, which a job's commit moves into place whole. Until then, and for good if
    the writer stops in between, readers of ``current_table`` see the version before; there is no moment without a table.
    Of two writers at once both versions stay, and all readers agree on the same one.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    newest = _newest(spark, root)
    version = f"v{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/versions/{version}")
    row = spark.createDataFrame([((newest[0] if newest else 0) + 1, version)], _POINTERS)
    row.coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return version


def _newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    try:
        row = spark.read.schema(_POINTERS).parquet(f"{root}/pointers").orderBy(F.desc("number"), "version").first()
    except Exception as error:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return (row["number"], row["version"]) if row else None


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table written by ``replace_table``."""
    root = path.rstrip("/")
    newest = _newest(spark, root)
    if newest is None:
        raise FileNotFoundError(f"no version of {path} yet")
    return spark.read.parquet(f"{root}/versions/{newest[1]}")


def forget_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Empty the versions that are neither among the ``keep`` newest nor emptied yet; their names.

    Readers that resolved the pointer earlier may still be on one of the newest.
    """
    root = path.rstrip("/")
    rows = spark.read.schema(_POINTERS).parquet(f"{root}/pointers").orderBy(F.desc("number"), "version").collect()  # a row per version
    gone = []
    for row in rows[max(1, keep):]:
        old = spark.read.parquet(f"{root}/versions/{row['version']}")
        if not old.isEmpty():
            spark.createDataFrame([], old.schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/versions/{row['version']}")
            gone.append(row["version"])
    return gone


def export_frame(df: DataFrame, kinds: Mapping[str, str], labels: Mapping[str, str] | None = None, blank: str = "no work") -> DataFrame:
    """Raw numbers, ISO dates, labelled grades and categories for an export."""
    shown = {"date", "category", "label"}
    return df.select(*[display(c, k, labels, blank).alias(c) if k in shown else F.col(c) for c, k in kinds.items()])


def stamped(df: DataFrame, scope: Mapping[str, str | None]) -> DataFrame:
    """Every row carries the filter it was exported under."""
    return df.withColumns({f"scope_{k}": F.lit(v) for k, v in scope.items()})


def write_manifest(spark: SparkSession, path: str, settings: Mapping[str, object]) -> None:
    """One-row JSON table with the settings of a run."""
    row = spark.createDataFrame([(json.dumps(settings, sort_keys=True, default=str),)], "settings string")
    row.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("settings string").json(path).first()["settings"])
