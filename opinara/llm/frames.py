"""Written intermediates and column helpers of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.session import scratch_path


def written(df: DataFrame, label: str, *partition_by: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later reads survive a lost executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, partitionBy=list(partition_by) or None, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    return name if name.lower() not in {c.lower() for c in df.columns} else f"{name}_{uuid.uuid4().hex[:8]}"


def named(df: DataFrame, name: str) -> Column:
    """The column with exactly this name, dots and blanks included."""
    return df[f"`{name.replace('`', '``')}`"]


def n_words(text: Column) -> Column:
    """Number of runs of characters outside ``[\\x20\\x09-\\x0D]``; null has none."""
    gaps = F.trim(F.translate(text, "\t\n\u000b\f\r", "     "))
    return F.coalesce(
        F.when(gaps == "", F.lit(0)).otherwise(F.size(F.split(gaps, " +"))), F.lit(0)
    ).cast("long")
