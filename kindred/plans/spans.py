"""Interval algebra and range joins over fixed-width bins.

Range conditions become equi-joins on (key, bin).  Spans are cut at bin edges, so a bin has
at most ``width`` distinct starts after the pre-aggregation, and only the first and the last
run of a bin take part in the stitching across bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

DEFAULT_WIDTH = 65536


def bin_of(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("bigint")


def span_bins(start: Column, end: Column, width: int) -> Column:
    """Bins touched by the half-open span [start, end)."""
    return F.sequence(bin_of(start, width), bin_of(end - 1, width))


def split_spans(
    df: DataFrame, start: str = "start", end: str = "end", width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Cut half-open spans at bin edges; adds ``__bin``.  Total length is unchanged."""
    lo, hi = F.col("__bin") * width, (F.col("__bin") + 1) * width
    return (
        df.filter(F.col(end) > F.col(start))
        .withColumn("__bin", F.explode(span_bins(F.col(start), F.col(end), width)))
        .withColumn(start, F.greatest(F.col(start), lo))
        .withColumn(end, F.least(F.col(end), hi))
    )


def merge_spans(
    df: DataFrame,
    keys: list[str],
    gap: int = 0,
    start: str = "start",
    end: str = "end",
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Union of half-open spans per key; spans at distance <= ``gap`` become one.

    Returns keys, start, end and ``covered`` (sum of the input lengths in the run).
    """
    pieces = split_spans(df, start, end, width)
    starts = pieces.groupBy(*keys, "__bin", start).agg(
        F.max(end).alias(end),
        F.sum(F.col(end) - F.col(start)).alias("covered"),
    )
    in_bin = W.partitionBy(*keys, "__bin").orderBy(start)
    reach = F.max(end).over(in_bin.rowsBetween(W.unboundedPreceding, -1))
    runs = (
        starts.withColumn("__new", (reach.isNull() | (F.col(start) > reach + gap)).cast("int"))
        .withColumn("__run", F.sum("__new").over(in_bin))
        .groupBy(*keys, "__bin", "__run")
        .agg(
            F.min(start).alias(start),
            F.max(end).alias(end),
            F.sum("covered").alias("covered"),
        )
    )
    per_bin = W.partitionBy(*keys, "__bin")
    runs = runs.withColumn(
        "__edge",
        (F.col("__run") == 1) | (F.col("__run") == F.max("__run").over(per_bin)),
    )
    inner = runs.filter(~F.col("__edge")).select(*keys, start, end, "covered")
    along = W.partitionBy(*keys).orderBy("__bin", "__run") if keys else W.orderBy("__bin", "__run")
    before = F.lag(end).over(along)
    chained = (
        runs.filter("__edge")
        .withColumn("__new", (before.isNull() | (F.col(start) > before + gap)).cast("int"))
        .withColumn("__chain", F.sum("__new").over(along))
        .groupBy(*keys, "__chain")
        .agg(
            F.min(start).alias(start),
            F.max(end).alias(end),
            F.sum("covered").alias("covered"),
        )
        .select(*keys, start, end, "covered")
    )
    return inner.unionByName(chained)


def points_to_spans(
    df: DataFrame, keys: list[str], pos: str, gap: int, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Half-open spans from 1-based positions; positions are bridged when pos - end <= gap.

    A position p covers [p-1, p), so ``pos - end <= gap`` is a span distance of gap - 1
    (-1 keeps even adjacent positions apart; one-base spans are never cut).
    """
    one_bp = df.select(
        *keys, (F.col(pos) - 1).alias("start"), F.col(pos).alias("end")
    ).distinct()
    return merge_spans(one_bp, keys, gap - 1, width=width)


def point_in_span(
    points: DataFrame,
    spans: DataFrame,
    keys: list[str],
    pos: str,
    start: str = "start",
    end: str = "end",
    width: int = DEFAULT_WIDTH,
    how: str = "inner",
    salts: int = 1,
) -> DataFrame:
    """Join 0-based points to half-open spans.  ``how``: inner, left, left_semi, left_anti.

    A span is repeated once per touched bin, a point once in all, and no pair appears twice.
    With ``salts`` the points of a bin are spread over that many tasks and the spans, which
    should then be the smaller side, are repeated for each.
    """
    p = points.withColumn("__bin", bin_of(F.col(pos), width))
    s = spans.filter(F.col(end) > F.col(start)).withColumn(
        "__sbin", F.explode(span_bins(F.col(start), F.col(end), width))
    )
    for k in keys:
        s = s.withColumnRenamed(k, f"__s_{k}")
    if salts > 1:
        hashed = [c for c, t in points.dtypes if not t.startswith("map")]
        p = p.withColumn("__salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
        s = s.withColumn("__ssalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = (
        (F.col("__bin") == F.col("__sbin"))
        & (F.col(pos) >= F.col(start))
        & (F.col(pos) < F.col(end))
    )
    for k in keys:
        on = on & (F.col(k) == F.col(f"__s_{k}"))
    if salts > 1:
        on = on & (F.col("__salt") == F.col("__ssalt"))
    return p.join(s, on, how).drop(
        "__bin", "__sbin", "__salt", "__ssalt", *[f"__s_{k}" for k in keys]
    )


def crowded_positions(
    df: DataFrame, keys: list[str], pos: str, distance: int, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Distinct (keys, pos) with another position of the key at 1..distance.

    Positions within ``distance`` of a bin edge are also copied into the next bin, so one
    lag/lead inside (key, bin) sees every neighbour that matters.
    """
    width = max(width, 4 * distance)
    at = F.col(pos)
    home = bin_of(at, width)
    copies = F.array_distinct(
        F.array(bin_of(at - distance, width), home, bin_of(at + distance, width))
    )
    halo = (
        df.select(*keys, pos)
        .distinct()
        .select(*keys, pos, home.alias("__home"), F.explode(copies).alias("__bin"))
    )
    w = W.partitionBy(*keys, "__bin").orderBy(pos)
    return (
        halo.withColumn("__prev", F.lag(pos).over(w))
        .withColumn("__next", F.lead(pos).over(w))
        .filter(F.col("__bin") == F.col("__home"))
        .filter((at - F.col("__prev") <= distance) | (F.col("__next") - at <= distance))
        .select(*keys, pos)
    )


def drop_crowded(
    df: DataFrame, keys: list[str], pos: str, distance: int = 150, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Keep rows whose key has no other position within ``distance``."""
    return df.join(crowded_positions(df, keys, pos, distance, width), [*keys, pos], "left_anti")


def isolated_rows(
    df: DataFrame, keys: list[str], pos: str, distance: int = 150, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """As ``drop_crowded``, in one pass, for tables with few rows per (key, position).

    Rows within ``distance`` of a bin edge are copied into the neighbouring bin.  Inside (key,
    bin) the nearest other position on each side is a running maximum over a range that ends
    one short of the row, once upwards and once downwards, so the input is planned once.
    """
    width = max(width, 4 * distance)
    at = F.col(pos).cast("bigint")
    home = bin_of(at, width)
    copies = F.array_distinct(F.array(bin_of(at - distance, width), home, bin_of(at + distance, width)))
    halo = df.select("*", home.alias("__home"), F.explode(copies).alias("__bin"))
    w = W.partitionBy(*keys, "__bin")
    below = F.max(at).over(w.orderBy(at).rangeBetween(W.unboundedPreceding, -1))
    above = F.min(at).over(w.orderBy((-at).alias("__down")).rangeBetween(W.unboundedPreceding, -1))
    return (
        halo.withColumn("__below", below)
        .withColumn("__above", above)
        .filter(F.col("__bin").eqNullSafe(F.col("__home")))
        .filter(F.coalesce(at - F.col("__below") > distance, F.lit(True)))
        .filter(F.coalesce(F.col("__above") - at > distance, F.lit(True)))
        .drop("__home", "__bin", "__below", "__above")
    )


def near_other(
    query: DataFrame,
    other: DataFrame,
    keys: list[str],
    pos: str,
    distance: int,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Distinct query (keys, pos) with a different ``other`` position within ``distance``.

    Both position sets are reduced to distinct positions and swept together inside
    (key, bin): the nearest ``other`` position on each side is a running max / min, so
    nothing is paired.
    """
    width = max(width, 4 * distance)
    at = F.col(pos)
    home = bin_of(at, width)
    copies = F.array_distinct(
        F.array(bin_of(at - distance, width), home, bin_of(at + distance, width))
    )
    both = (
        query.select(*keys, pos, F.lit(1).alias("__q"), F.lit(0).alias("__o"))
        .unionByName(other.select(*keys, pos, F.lit(0).alias("__q"), F.lit(1).alias("__o")))
        .groupBy(*keys, pos)
        .agg(F.max("__q").alias("__q"), F.max("__o").alias("__o"))
        .select(*keys, pos, "__q", "__o", home.alias("__home"), F.explode(copies).alias("__bin"))
    )
    w = W.partitionBy(*keys, "__bin").orderBy(pos)
    other_pos = F.when(F.col("__o") == 1, at)
    return (
        both.withColumn(
            "__prev", F.max(other_pos).over(w.rowsBetween(W.unboundedPreceding, -1))
        )
        .withColumn("__next", F.min(other_pos).over(w.rowsBetween(1, W.unboundedFollowing)))
        .filter((F.col("__q") == 1) & (F.col("__bin") == F.col("__home")))
        .filter((at - F.col("__prev") <= distance) | (F.col("__next") - at <= distance))
        .select(*keys, pos)
    )
