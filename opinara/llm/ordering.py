"""Ranks and running sums over all rows of a group without a window over the whole group.

Rows carry a sort key that is uniform text (a hex digest).  A group is cut at the key's leading digits into
cells of about ``cell_rows`` rows; one small aggregate gives each cell's total, a window over cells its
offset, and a window inside each cell the rest.  A group with a third of all rows is just more cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 50_000


def digits_for(n_rows: int, cell_rows: int = CELL_ROWS) -> int:
    """How many leading hex digits cut ``n_rows`` rows into cells of at most about ``cell_rows``."""
    return max(1, math.ceil(math.log(max(n_rows / cell_rows, 1), 16)))


def running(df: DataFrame, by: Sequence[str], key: str, ties: Sequence[Column], measures: dict[str, Column],
            digits: int) -> DataFrame:
    """``df`` plus, for each measure, the sum over all rows of the group ``by`` that come before this one."""
    cell = F.substring(key, 1, digits)
    rows = df.withColumns({"_cell": cell, **{f"_m_{name}": value for name, value in measures.items()}})
    totals = rows.groupBy(*by, "_cell").agg(*(F.sum(f"_m_{name}").alias(f"_s_{name}") for name in measures))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(b).alias(f"_g_{i}") for i, b in enumerate(by)), F.col("_cell").alias("_o_cell"),
        *(F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in measures),
    )
    inside = Window.partitionBy(*by, "_cell").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumns(
        {f"_i_{name}": F.coalesce(F.sum(f"_m_{name}").over(inside), F.lit(0)) for name in measures}
    )
    same = F.col("_cell") == F.col("_o_cell")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_g_{i}"))
    return ranked.join(offsets, same).select(
        *df.columns, *((F.col(f"_o_{name}") + F.col(f"_i_{name}")).alias(name) for name in measures)
    )
