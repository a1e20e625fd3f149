"""Tables that must be computed once and survive a lost executor."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the shared root."""
    return f"{shared_root(spark)}/rollcall-{uuid.uuid4().hex}"


def settled(frame: DataFrame) -> DataFrame:
    """``frame`` written once below the shared root and read back: lineage ends here."""
    spark = frame.sparkSession
    folder = scratch_folder(spark)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def measured(frame: DataFrame, **figures: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``settled``, and aggregates over all its rows, taken while it is written: no second scan."""
    seen = Observation()
    table = settled(frame.observe(seen, *[value.alias(name) for name, value in figures.items()]))
    return table, seen.get
