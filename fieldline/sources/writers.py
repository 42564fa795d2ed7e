"""Sinks: CSV for reports, parquet for tables that later jobs read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV folder with a header in each part; NULL is written as nothing."""
    df.write.mode(mode).option("header", True).option("nullValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Raw events as parquet, one folder per match period for pruning.

    Rows stay where they are, so a match that holds most events is written by
    many tasks.
    """
    write_parquet(events, path, ["matchPeriod"], mode)
