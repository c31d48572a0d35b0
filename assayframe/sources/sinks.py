"""Writing cleaned tables, cleaning logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes are doubled inside quoted fields."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_log(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The cleaning log as one CSV file: it has one row per step."""
    write_csv(log.coalesce(1), path, mode)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The report rows as JSON lines, one folder per section."""
    report.write.mode(mode).partitionBy("section").json(path)
