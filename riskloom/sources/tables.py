"""Parquet sources by name, as DataFrames or temporary views (pruned and pushed down by Catalyst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: A shop's tables; read by name, not registered as views.
SHOP = ("clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, column_name, place) of every source table, from the files' own schemas."""
    rows = [(t, c, i) for t in TABLES for i, c in enumerate(table(spark, sf_dir, t).columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, place int")


CATALOGUE = "select table_name, column_name, cast(ordinal_position as int) place from information_schema.columns where table_name in (" + ", ".join(f"'{t}'" for t in TABLES) + ")"
