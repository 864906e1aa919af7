"""Inputs of the registered queries. The derived atom relation is staged once per table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import stage
from ..sources import tables

_ATOMS: dict[tuple[str, str], DataFrame] = {}


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ATOMS:
        _ATOMS[key] = stage(tables.atoms(spark, sf_dir))
    return _ATOMS[key]
