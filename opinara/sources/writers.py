"""Sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.sources import manifest


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    df.write.mode(mode).parquet(path, compression=compression)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append an analysed run in its own folder and list it in the manifest; reading picks the newest."""
    manifest.write_listed(df.drop("run_id"), path, f"{path}/run_id={run_id}", run_id)


def write_batch(df: DataFrame, folder: str, number: int) -> None:
    """Append a collected batch below ``folder`` and list it in the manifest."""
    name = f"batch_{number:04d}_reviews.parquet"
    manifest.write_listed(df, folder, f"{folder}/{name}", name)


def csv_ready(df: DataFrame) -> DataFrame:
    """CSV holds no arrays, so they are written as JSON text."""
    def flat(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        return (F.to_json(column) if nested else column).alias(field.name)

    return df.select(*[flat(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    csv_ready(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_merged(df: DataFrame, folder: str) -> None:
    """The merged reviews as Parquet and as CSV."""
    write_parquet(df, f"{folder}/collected_all_reviews.parquet")
    write_csv(df, f"{folder}/collected_all_reviews.csv")


def write_results(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One directory per result table."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def write_queries(df: DataFrame, path: str) -> None:
    """One query per line."""
    df.select(F.col("query").alias("value")).write.mode("overwrite").text(path)
