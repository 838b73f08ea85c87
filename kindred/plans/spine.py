"""Fixed category lists and zero filling.

A spine is a literal array exploded on the strata, never a cross join: its length is fixed
by the domain (8 classes, 32 contexts, 96 categories).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
SUBSTITUTIONS = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")
# Mutation classes in report order.
CLASSES7 = ("C>A", "C>G", "C>T_nonCpG", "C>T_CpG", "T>A", "T>C", "T>G")
CLASSES8 = ("overall", *CLASSES7)
SBS96 = tuple(
    f"{five}[{sub}]{three}" for sub in SUBSTITUTIONS for five in BASES for three in BASES
)
TRINUC32 = tuple(
    f"{five}{mid}{three}" for mid in ("C", "T") for five in BASES for three in BASES
)


def with_categories(strata: DataFrame, values, name: str, rank: str | None = None) -> DataFrame:
    """One row per stratum and category, in the given order (``rank`` is 1-based)."""
    literal = F.array(*[F.lit(v) for v in values])
    if rank is None:
        return strata.withColumn(name, F.explode(literal))
    out = strata.select("*", F.posexplode(literal).alias(rank, name))
    return out.withColumn(rank, F.col(rank) + 1)


def with_replicates(strata: DataFrame, n: int, name: str = "rep") -> DataFrame:
    """One row per stratum and replicate number 0..n-1."""
    return strata.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def fill_left(spine: DataFrame, observed: DataFrame, on: list[str], zero: list[str]) -> DataFrame:
    """Left join the observations to the spine and replace missing measures by 0."""
    return spine.join(observed, on, "left").fillna(0, subset=zero)


def dense_counts(
    counts: DataFrame,
    strata: list[str],
    category: str,
    n: str,
    values,
    rank: str | None = None,
    overall: str | None = None,
) -> DataFrame:
    """All categories per stratum, zero filled, from a (strata, category) -> n table.

    The counts of a stratum become one map with at most ``len(values)`` entries, and the
    literal list is looked up in it: no second pass for the strata and no join.  Rows with a
    NULL category vanish, yet their stratum stays.  ``overall`` names an extra total row.
    """
    known = F.col(category).isNotNull()
    maps = counts.groupBy(*strata).agg(
        F.map_from_entries(F.collect_list(F.when(known, F.struct(category, n)))).alias("__m"),
        F.coalesce(F.sum(F.when(known, F.col(n))), F.lit(0)).cast("bigint").alias("__t"),
    )
    listed = with_categories(maps, values, "__c", rank)
    zero = F.lit(0).cast("bigint")
    found = F.coalesce(F.try_element_at(F.col("__m"), F.col("__c")), zero)
    amount = F.when(F.col("__c") == overall, F.col("__t")).otherwise(found) if overall else found
    return listed.select(
        *strata,
        *([rank] if rank else []),
        F.col("__c").alias(category),
        amount.cast("bigint").alias(n),
        F.col("__t").alias("total"),
    )
