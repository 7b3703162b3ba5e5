"""The first rows of each group, whatever the size of a group."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def first_per_group(
    df: DataFrame, group: list[str], order: list[Column], n: int, spread_by: str, rank: str
) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1 in ``rank``.

    Rows are ranked in two steps: first in 64 parts of each group (by the hash of ``spread_by``), then the
    survivors. A group holding most of the table is thus ranked by many tasks, and the last step sees at
    most 64 x ``n`` rows per group. For ``n`` up to 1000 Spark also cuts each part before the shuffle.
    """
    part = F.pmod(F.xxhash64(spread_by), F.lit(PARTS))
    in_part = Window.partitionBy(*group, "_part").orderBy(*order)
    kept = df.withColumn("_part", part).withColumn(rank, F.row_number().over(in_part))
    kept = kept.where(F.col(rank) <= n).drop("_part", rank)
    ranked = kept.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)
