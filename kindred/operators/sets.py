"""Set operations on keyed tables: labelled unions, differences and overlaps with a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_union(parts: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """Rows of all tables with the name of theirs; columns that a table lacks are NULL."""
    if not parts:
        raise ValueError("no tables to unite")
    united = None
    for name, df in parts.items():
        rows = df.withColumn(label, F.lit(name))
        united = rows if united is None else united.unionByName(rows, allowMissingColumns=True)
    return united


def counts_by_source(parts: dict[str, DataFrame], by: list[str], label: str = "source") -> DataFrame:
    """(label, by, n): rows per table and key.  Each table is counted before they are united."""
    counted = {name: df.groupBy(*by).agg(F.count("*").alias("n")) for name, df in parts.items()}
    return labelled_union(counted, label).select(label, *by, "n")


def keys_without(df: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``dropped`` does not list.  NULL keys are compared as equal."""
    return df.select(*keys).subtract(dropped.select(*keys))


def mostly(df: DataFrame, keys: list[str], condition: Column, share: float) -> DataFrame:
    """Keys of which more than ``share`` of the rows meet a condition (a NULL does not)."""
    met = F.count_if(F.coalesce(condition, F.lit(False)))
    return df.groupBy(*keys).agg((met / F.count("*")).alias("__share")).filter(F.col("__share") > share).select(*keys)


def members_overlap(df: DataFrame, keys: list[str], member: str, listed: Column) -> DataFrame:
    """(keys, sampled, n_members): whether any member of a group is in ``listed``, an array of its keys.

    Two counts per group: the members are counted once each, and no list of them is gathered.
    """
    each = df.select(*keys, member, F.array_contains(listed, F.col(member)).alias("__in")).distinct()
    return each.groupBy(*keys).agg(
        F.coalesce(F.bool_or("__in"), F.lit(False)).alias("sampled"), F.count(member).alias("n_members")
    )
