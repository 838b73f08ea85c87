"""Runs of kept sites, region filters, fixed segments and dense contig codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..plans import spans
from ..plans.running import position_bucket, range_buckets, running


def bridge_intervals(df: DataFrame, keys: list[str], gap: int, start="start", end="end", width=spans.DEFAULT_WIDTH) -> DataFrame:
    """Bridged spans with the share of the span that was covered."""
    merged = spans.merge_spans(df, keys, gap, start, end, width)
    return merged.withColumn(
        "callable_fraction", F.col("covered") / (F.col(end) - F.col(start))
    )


def merge_two(a: DataFrame, b: DataFrame, keys: list[str], start="start", end="end", width=spans.DEFAULT_WIDTH) -> DataFrame:
    """Union of two interval sets."""
    cols = [*keys, start, end]
    return spans.merge_spans(a.select(cols).unionByName(b.select(cols)), keys, 0, start, end, width).drop("covered")


def uncallable_spans(runs: DataFrame, bounds: DataFrame, keys: list[str], start="start", end="end", width=spans.DEFAULT_WIDTH) -> DataFrame:
    """Merged spans whose depth is outside the callable window."""
    out = runs.join(bounds.select("callable_min", "callable_max", *[k for k in keys if k in bounds.columns]),
                    [k for k in keys if k in bounds.columns])
    bad = (F.col("depth") < F.col("callable_min")) | (F.col("depth") > F.col("callable_max"))
    return spans.merge_spans(out.filter(bad), keys, 0, start, end, width).drop("covered")


def nearest_neighbour(points: DataFrame, keys: list[str], pos: str = "pos", width: int = 65536) -> DataFrame:
    """Distance to the nearest other point of the key; points of a singleton key are left out.

    Repeated positions have distance 0.
    """
    from ..plans.running import neighbours

    counted = points.groupBy(*keys, pos).agg(F.count("*").alias("n"))
    near = neighbours(counted, keys, pos, width)
    gap = F.least(F.col(pos) - F.col("prev_pos"), F.col("next_pos") - F.col(pos))
    return (
        near.withColumn("distance", F.when(F.col("n") > 1, F.lit(0)).otherwise(gap))
        .filter("distance IS NOT NULL")
        .select(*keys, pos, "n", "distance")
    )


def mean_nearest_neighbour(points: DataFrame, keys: list[str], group: list[str] = (), pos: str = "pos", width: int = 65536) -> DataFrame:
    near = nearest_neighbour(points, keys, pos, width)
    return near.groupBy(*group).agg(
        (F.sum(F.col("distance") * F.col("n")) / F.sum("n")).alias("mean_distance"),
        F.sum("n").alias("n_points"),
    )


def runs(
    sites: DataFrame, keys: list[str], site: str, removed: str, poly: str, width: int = 65536, last_again: bool = False
) -> DataFrame:
    """Runs of kept sites: start, exclusive end (next removed site, or last site + 1) and
    the share of polymorphic sites.

    The run of a kept site is named by the next removed site, a running minimum from the
    right, so no key is gathered in one task.  As in the report this feeds, the site at the
    end belongs to the polymorphic count and to the length.  A run that reaches the last site of
    its key has no removed site at its end; with ``last_again`` its last site is then counted a
    second time in that place, as the report does by repeating the last row.
    """
    marked = sites.withColumn("__stop", F.when(F.col(removed), F.col(site)))
    named = running(
        marked, keys, site, position_bucket(site, width), {"__end": ("min", "__stop")}, reverse=True
    )
    kept = ~F.col(removed)
    per = named.groupBy(*keys, "__end").agg(
        F.min(F.when(kept, F.col(site))).alias("start"),
        F.max(F.when(kept, F.col(site))).alias("__last"),
        F.count_if(F.col(poly)).alias("n_poly"),
        F.max_by(F.when(F.col(poly), 1).otherwise(0), F.col(site)).alias("__again"),
    )
    if last_again:
        per = per.withColumn("n_poly", F.col("n_poly") + F.when(F.col("__end").isNull(), F.col("__again")).otherwise(0))
    return (
        per.filter("start IS NOT NULL")
        .withColumn("end", F.coalesce("__end", F.col("__last") + 1))
        .withColumn("poly_stat", F.col("n_poly") / (F.col("end") - F.col("start") + 1))
        .select(*keys, "start", "end", "n_poly", "poly_stat")
    )


def region_filter(regions: DataFrame, min_log10: float = 2.5, max_poly: float = 0.15) -> DataFrame:
    """Inclusive end and length; keep long regions with few polymorphic sites."""
    return (
        regions.withColumn("end", F.col("end") - 1)
        .withColumn("len", F.col("end") - F.col("start") + 1)
        .filter((F.log10("len") > min_log10) & (F.col("poly_stat") < max_poly))
    )


def make_segments(lengths: DataFrame, size: int, prefix: str) -> DataFrame:
    """Fixed tiling ``chrom:start-end`` with zero-padded ids in natural chromosome order.

    Ids come from a running count of segments per chromosome, over ranges of the chromosome
    table, however many contigs it has.  A last segment of one base is kept.
    """
    n = F.ceil(F.col("length") / F.lit(size)).cast("bigint")
    ranked = lengths.withColumns({"__n": n, "__order": F.struct(ids.chrom_rank("chrom").alias("rank"), F.col("chrom").alias("name"))})
    firsts = running(
        range_buckets(ranked, "__order"), [], "__order", F.col("__range"), {"__first": ("sum", "__n")}, inclusive=False
    ).withColumn("__first", F.coalesce("__first", F.lit(0)))
    i = F.col("__i")
    start = i * size + 1
    return firsts.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1))).select(
        "chrom",
        start.alias("start"),
        F.least(start + size - 1, F.col("length")).alias("end"),
        F.concat_ws(
            "_",
            F.lit(prefix),
            (lambda v: F.when(F.length(v) < 3, F.lpad(v, 3, "0")).otherwise(v))((F.col("__first") + i).cast("string")),
        ).alias("segment_id"),
    ).withColumn(
        "interval", F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    )


def dense_codes(df: DataFrame, column: str, order: str, width: int = 65536) -> DataFrame:
    """Codes 1..n per contig in the order of the smallest ``order`` value (an integer), then
    by name; sex contigs raise on execution.

    The code is a running count over the first values, so contigs are not gathered in one
    task however many there are.
    """
    first = df.groupBy(column).agg(F.min(order).alias("__first"))
    counts = first.groupBy("__first").agg(F.count("*").alias("__n"))
    before = running(
        counts, [], "__first", position_bucket("__first", width), {"__before": ("sum", "__n")}, inclusive=False
    ).drop("__n")
    tie = F.row_number().over(W.partitionBy("__first").orderBy(column))
    checked = F.when(
        ids.is_sex_contig(column), F.raise_error(F.concat(F.lit("sex contig: "), F.col(column))).cast("int")
    ).otherwise((F.col("__before") + tie).cast("int"))
    return first.join(before, "__first").select(F.col(column).alias("original"), checked.alias("code"))


def chromosome_order(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    return df.orderBy(ids.chrom_rank(chrom), chrom)


def with_chromosome_place(chroms: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Place 1..n of each chromosome of a chromosome table in natural order."""
    order = W.orderBy(ids.chrom_rank(chrom), chrom)
    return chroms.withColumn("place", F.row_number().over(order).cast("bigint"))
