"""Depth and callable-genome statistics.

Depths are small integers, so every exact quantile comes from a (key, depth) -> count
histogram: the shuffle carries one row per distinct depth and the quantile buffer is bounded
by the depth range, however many sites a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.running import position_bucket, running
from ..plans.spine import dense_counts


def depth_histogram(df: DataFrame, keys: list[str], value: str = "dp", weight: Column | None = None) -> DataFrame:
    """(keys, value) -> count; histograms of shards add up."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*keys, value).agg(n.alias("count"))


def merge_histograms(hist: DataFrame, keys: list[str], value: str = "dp") -> DataFrame:
    return hist.groupBy(*keys, value).agg(F.sum("count").alias("count"))


def histogram_stats(
    hist: DataFrame, keys: list[str], value: str = "dp", quantiles: dict[str, float] | None = None
) -> DataFrame:
    """Exact n, mean, median and linear quantiles of a histogram."""
    quantiles = quantiles or {}
    v, n = F.col(value), F.col("count")
    aggs = [
        F.sum("count").alias("n"),
        (F.sum(v * n) / F.sum("count")).alias("mean"),
        F.percentile(v, F.lit(0.5), n).alias("median"),
    ]
    aggs += [F.percentile(v, F.lit(q), n).alias(name) for name, q in quantiles.items()]
    return hist.groupBy(*keys).agg(*aggs) if keys else hist.agg(*aggs)


# Reported quantiles of per-chromosome depth.
DEPTH_QUANTILES = {"q025": 0.025, "q25": 0.25, "q75": 0.75, "q975": 0.975}


def depth_quantiles(depth: DataFrame, keys: list[str], value: str = "depth") -> DataFrame:
    """Mean, median and linear quantiles per key."""
    return histogram_stats(depth_histogram(depth, keys, value), keys, value, DEPTH_QUANTILES)


def depth_mean_std(calls: DataFrame, keys: list[str], value: str = "dp") -> DataFrame:
    """Mean and population standard deviation; a key without depths gives 0."""
    return calls.groupBy(*keys).agg(
        F.count(value).alias("n_sites"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_depth"),
        F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std_depth"),
    )


#: Slots of the chromosome lengths when they are paired with samples.
LENGTH_SLOTS = 16


def coverage_stats(depth: DataFrame, lengths: DataFrame, keys: list[str] = ("sample", "chrom")) -> DataFrame:
    """Covered bases, total depth, mean over the chromosome, mean and median where covered.

    Every chromosome of ``lengths`` has a row for each of the other keys in ``depth``: one
    without a covered base has a mean of 0 over its length and NULL where covered.  The pairs
    are formed by an equi-join on slots of the chromosomes.
    """
    others = [k for k in keys if k != "chrom"]
    slot = F.pmod(F.xxhash64("chrom"), F.lit(LENGTH_SLOTS)).cast("int")
    spine = lengths
    if others:
        every = F.explode(F.sequence(F.lit(0), F.lit(LENGTH_SLOTS - 1)))
        groups = depth.select(*others).distinct().withColumn("__slot", every)
        spine = groups.join(lengths.withColumn("__slot", slot), "__slot").drop("__slot")
    hist = depth_histogram(depth, list(keys), "depth")
    v, n = F.col("depth"), F.col("count")
    seen = F.when(v >= 1, n)
    zero = F.lit(0).cast("bigint")
    stats = hist.groupBy(*keys).agg(
        F.sum(seen).alias("covered_bases"),
        F.sum(v * seen).alias("total_depth"),
        F.percentile(F.when(v >= 1, v), F.lit(0.5), F.coalesce(seen, zero)).alias("median_covered"),
    )
    covered = F.col("covered_bases") > 0
    return (
        spine.join(stats, list(keys), "left")
        .fillna(0, subset=["covered_bases", "total_depth"])
        .withColumn("mean_all", F.coalesce(F.try_divide(F.col("total_depth"), F.col("length")), F.lit(0.0)))
        .withColumn("mean_covered", F.when(covered, F.col("total_depth") / F.col("covered_bases")))
    )


def dp_stats(calls: DataFrame, keys: list[str], value: str = "dp") -> DataFrame:
    """Mean and median over all sites (missing = 0) and over sites with depth >= 1."""
    hist = depth_histogram(
        calls.withColumn(value, F.coalesce(F.col(value), F.lit(0))), keys, value
    )
    v, n = F.col(value), F.col("count")
    seen = F.when(v >= 1, n)
    return hist.groupBy(*keys).agg(
        F.sum(n).alias("n_sites"),
        (F.sum(v * n) / F.sum(n)).alias("mean_all"),
        F.percentile(v, F.lit(0.5), n).alias("median_all"),
        (F.sum(v * seen) / F.sum(seen)).alias("mean_covered"),
        F.percentile(F.when(v >= 1, v), F.lit(0.5), F.when(v >= 1, n).otherwise(F.lit(0))).alias(
            "median_covered"
        ),
    )


# --- run-length encoded depth ----------------------------------------------------------


def run_depth_histogram(runs: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Bases per depth from run-length rows."""
    return depth_histogram(
        runs.filter(F.col(end) > F.col(start)), keys, "depth", F.col(end) - F.col(start)
    )


def cumulative_distribution(hist: DataFrame, keys: list[str], value: str = "depth") -> DataFrame:
    """Cumulative count and fractions by value, for values > 0."""
    covered = hist.filter(F.col(value) > 0)
    total = covered.groupBy(*keys).agg(F.sum("count").alias("n_covered"))
    run = running(covered, keys, value, position_bucket(value, 4096), {"cumulative": ("sum", "count")})
    return (
        run.join(total, keys)
        .withColumn("frac", F.col("count") / F.col("n_covered"))
        .withColumn("cumulative_frac", F.col("cumulative") / F.col("n_covered"))
    )


# Reported lower quantiles of covered depth.
RUN_QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def weighted_depth(runs: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Totals, covered fraction, weighted mean and lower quantiles of covered depth."""
    hist = run_depth_histogram(runs, keys, start, end)
    totals = hist.groupBy(*keys).agg(
        F.sum("count").alias("total_bases"),
        F.coalesce(F.sum(F.when(F.col("depth") > 0, F.col("count"))), F.lit(0)).alias("covered_bases"),
        (
            F.sum(F.when(F.col("depth") > 0, F.col("depth") * F.col("count")))
            / F.sum(F.when(F.col("depth") > 0, F.col("count")))
        ).alias("covered_mean"),
    )
    dist = cumulative_distribution(hist, keys)
    cuts = dist.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("cumulative") >= q * F.col("n_covered"), F.col("depth"))).alias(name)
            for name, q in RUN_QUANTILES.items()
        ]
    )
    return totals.join(cuts, keys, "left").withColumn(
        "covered_fraction", F.col("covered_bases") / F.col("total_bases")
    )


def callable_bounds(
    stats: DataFrame, floor: int = 5, lo: float = 0.5, hi: float = 2.0, median: str = "p50"
) -> DataFrame:
    """Depth window max(floor, ceil(lo·median)) .. floor(hi·median)."""
    m = F.col(median)
    return stats.withColumn(
        "callable_min", F.greatest(F.lit(floor).cast("bigint"), F.ceil(m * lo))
    ).withColumn("callable_max", F.floor(m * hi))


def callable_range_share(distribution: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Share of covered bases inside the callable depth window."""
    inside = F.col("depth").between(F.col("callable_min"), F.col("callable_max"))
    return (
        distribution.join(bounds.select(*keys, "callable_min", "callable_max"), keys)
        .groupBy(*keys)
        .agg(F.coalesce(F.sum(F.when(inside, F.col("frac"))), F.lit(0.0)).alias("in_range"))
    )


# --- callable genome --------------------------------------------------------------------


def callable_per_individual(
    callable_bp: DataFrame, lengths: DataFrame, x_chroms: list[str], individual: str = "child", bp: str = "bp"
) -> DataFrame:
    """Autosomal callable bases and percent of the autosomal genome length."""
    genome = lengths.filter(~F.col("chrom").isin(*x_chroms)).agg(F.sum("length").alias("genome"))
    per = (
        callable_bp.filter(~F.col("chrom").isin(*x_chroms))
        .groupBy(individual)
        .agg(F.sum(bp).alias("callable_bp"))
    )
    # one-row side: a scalar, not a growing table
    return per.join(F.broadcast(genome)).select(
        individual, "callable_bp", (100.0 * F.col("callable_bp") / F.col("genome")).alias("percent")
    )


def callable_fraction(callable_bp: DataFrame, lengths: DataFrame, individual: str = "child", bp: str = "bp") -> DataFrame:
    """Long form of the callable fraction per individual and chromosome."""
    return (
        callable_bp.groupBy(individual, "chrom")
        .agg(F.sum(bp).alias("bp"))
        .join(lengths, "chrom")
        .select(individual, "chrom", (F.col("bp") / F.col("length")).alias("fraction"))
    )


def callable_fraction_matrix(
    callable_bp: DataFrame, lengths: DataFrame, chroms: list[str], individual: str = "child", bp: str = "bp"
) -> DataFrame:
    """Individuals x chromosomes; the column list is given, so no extra pass looks for it."""
    return (
        callable_fraction(callable_bp, lengths, individual, bp)
        .groupBy(individual)
        .pivot("chrom", chroms)
        .agg(F.first("fraction"))
    )


def window_counts(
    points: DataFrame, lengths: DataFrame, size: int, keys: list[str] = (), pos: str = "pos", out: str = "n"
) -> DataFrame:
    """Counts in 1-based windows of ``size``; every window is listed, the last is clipped."""
    keys = list(keys)
    start = (F.floor((F.col(pos) - 1) / F.lit(size)) * size + 1).cast("bigint")
    counts = points.groupBy(*keys, "chrom", start.alias("window_start")).agg(F.count("*").alias(out))
    spine = all_windows(lengths, size)
    if keys:
        strata = points.select(*keys, "chrom").distinct()
        spine = spine.join(strata, "chrom")
    return spine.join(counts, [*keys, "chrom", "window_start"], "left").fillna(0, subset=[out])


def all_windows(lengths: DataFrame, size: int) -> DataFrame:
    s = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("length"), F.lit(size).cast("bigint")))
    return lengths.select("chrom", "length", s.alias("window_start")).select(
        "chrom",
        "window_start",
        F.least(F.col("window_start") + size - 1, F.col("length")).alias("window_end"),
    )


def merge_partials(partials: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Totals over shards or offspring."""
    return partials.groupBy(*keys).agg(F.sum(value).alias(value))


def window_enrichment(windows: DataFrame, observed: str = "observed", callable_col: str = "callable_sites", keys: list[str] = ()) -> DataFrame:
    """Expected counts proportional to callable sites, and observed/expected (NULL on 0)."""
    keys = list(keys)
    totals = windows.groupBy(*keys).agg(
        F.sum(observed).alias("__n"), F.sum(callable_col).alias("__c")
    )
    joined = windows.join(totals, keys) if keys else windows.join(F.broadcast(totals))
    expected = F.col("__n") * F.col(callable_col) / F.col("__c")
    return joined.withColumn("expected", expected).withColumn(
        "enrichment",
        F.when(F.col("expected") > 0, F.col(observed) / F.col("expected")),
    ).drop("__n", "__c")


# --- contig lengths ----------------------------------------------------------------------


def contigs(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """Runs of called bases: a sequence split on N, empty parts left out."""
    parts = F.filter(F.split(F.upper(F.col(seq)), "N"), lambda s: F.length(s) > 0)
    return seqs.withColumn("contig", F.explode(parts)).withColumn("length", F.length("contig"))


def nx(lengths: DataFrame, keys: list[str], percents: list[int] = (50, 90, 95), length: str = "length") -> DataFrame:
    """N50-style statistics from a length histogram and a running sum from the longest."""
    hist = lengths.groupBy(*keys, length).agg(F.count("*").alias("__n"))
    hist = hist.withColumn("__bases", F.col(length) * F.col("__n"))
    run = running(
        hist, keys, length, position_bucket(length, 65536), {"__cum": ("sum", "__bases")}, reverse=True
    )
    total = hist.groupBy(*keys).agg(
        F.sum("__bases").alias("total_length"),
        F.sum("__n").alias("n_contigs"),
        F.max(length).alias("longest"),
        F.min(length).alias("shortest"),
    )
    out = (run.join(total, keys) if keys else run.join(F.broadcast(total)))
    return out.groupBy(*keys, "total_length", "n_contigs", "longest", "shortest").agg(
        *[
            F.max(F.when(F.col("__cum") >= F.col("total_length") * p / 100, F.col(length))).alias(f"n{p}")
            for p in percents
        ]
    )


# Contig length classes (upper bounds inclusive).
LENGTH_CLASSES = (
    (1000, "<1kb"), (5000, "1-5kb"), (10000, "5-10kb"), (50000, "10-50kb"),
    (100000, "50-100kb"), (500000, "100-500kb"), (1000000, "500kb-1Mb"),
)


def length_class(length: Column, classes=LENGTH_CLASSES, last: str = ">1Mb") -> Column:
    out = F.lit(last)
    for bound, label in reversed(classes):
        out = F.when(length <= bound, F.lit(label)).otherwise(out)
    return out


def length_bins(df: DataFrame, length: str = "length", classes=LENGTH_CLASSES) -> DataFrame:
    return df.groupBy(length_class(F.col(length), classes).alias("length_class")).agg(
        F.count("*").alias("n")
    )


def gc_content(seq: Column) -> Column:
    """Percent G+C of a sequence."""
    return 100.0 * F.length(F.regexp_replace(F.upper(seq), "[^GC]", "")) / F.length(seq)


def ad_histogram(
    df: DataFrame, keys: list[str], bins: int = 100, ref: str = "ref_dp", alt: str = "alt_dp"
) -> DataFrame:
    """Alternate read fraction in ``bins`` equal bins, zero filled; 1.0 is in the last bin.

    The bin starts from floor(f·bins) and is corrected against the edges i/bins, so a value
    equal to an edge in floating point lands in the bin that starts there.
    """
    total = F.col(ref) + F.col(alt)
    f = F.col("__f")
    guess = F.floor(f * bins).cast("int")
    edge = lambda i: i / F.lit(float(bins))
    fixed = F.when(f < edge(guess), guess - 1).when(f >= edge(guess + 1), guess + 1).otherwise(guess)
    counts = (
        df.filter(total > 0)
        .withColumn("__f", F.col(alt) / total)
        .groupBy(*keys, F.least(fixed, F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    return dense_counts(counts, keys, "bin", "count", range(bins)).drop("total")


def grand_mean(tables: list[DataFrame], value: str) -> DataFrame:
    """Union of per-species tables with the mean over all rows attached."""
    everything = tables[0]
    for other in tables[1:]:
        everything = everything.unionByName(other)
    mean = everything.agg(F.avg(value).alias("grand_mean"))
    return everything.join(F.broadcast(mean))


def mean_depth_report(alignments: DataFrame, calls: DataFrame, keys: list[str] = ("sample", "chrom")) -> DataFrame:
    """(keys, bam_mean, vcf_mean): mean depth of the alignments beside that of the calls.

    ``alignments`` has depth, ``calls`` has dp.  Both are aggregated before they meet, so the join is
    between one row per key; keys that one side lacks are left out.
    """
    left = alignments.groupBy(*keys).agg(F.avg("depth").alias("bam_mean"))
    right = calls.groupBy(*keys).agg(F.avg("dp").alias("vcf_mean"))
    return left.join(right, list(keys))
