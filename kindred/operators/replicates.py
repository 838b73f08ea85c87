"""Bootstrap and null replicates as tables of hash draws.

Strata are aggregated before replication, replicates are exploded on them, and a draw is a
hash of (seed, label, replicate, slot), so results do not depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.special import binomial_quantile, gammaincc
from ..plans import spans
from ..plans.cut import cut_lineage
from ..plans.draws import draw_index, hash_int, uniform
from ..plans.lookup import lookup_join
from ..plans.running import dense_index, exact_quantiles, position_bucket, range_buckets, running
from ..plans.spine import with_replicates
from .regions import mean_nearest_neighbour

#: Tasks that blocks of drawn points are dealt out over.
DRAW_TASKS = 96

CI = {"ci_low": 0.025, "median": 0.5, "ci_high": 0.975}


def replicate_summary(reps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median and 2.5/97.5 percentiles over replicates; NULLs are skipped.

    The replicates (one row per key and replicate) are read in several branches and stored once.
    """
    reps = cut_lineage(reps.select(*keys, value))
    base = reps.groupBy(*keys).agg(F.count(value).alias("n_reps"), F.avg(value).alias("mean"))
    return base.join(exact_quantiles(reps, keys, value, CI), keys, "left")


def replicate_summaries(reps: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The same for several metrics, one row per key and metric."""
    long = reps.unpivot(keys, values, "metric", "value")
    return replicate_summary(long, [*keys, "metric"], "value")


# --- resampling -------------------------------------------------------------------------


def bootstrap_keys(df: DataFrame, key: str, n_rep: int, seed: int, strata: list[str] = ()) -> DataFrame:
    """(strata, rep, slot, key): as many draws with replacement as there are keys."""
    strata = list(strata)
    index = cut_lineage(dense_index(df, key, strata))
    size = index.groupBy(*strata).agg(F.count("*").alias("__n"))
    slots = index.select(*strata, F.col("idx").alias("slot"))
    slots = slots.join(size, strata) if strata else slots.join(F.broadcast(size))
    draws = with_replicates(slots, n_rep).withColumn(
        "idx", draw_index(F.col("__n"), F.lit(seed), *[F.col(s) for s in strata], F.col("rep"), F.col("slot"))
    )
    return draws.join(index, [*strata, "idx"]).select(*strata, "rep", "slot", key)


def bootstrap_rate(trios: DataFrame, trio: str, by: list[str], n_rep: int, seed: int, strata: list[str] = (), ploidy: int = 2) -> DataFrame:
    """Rate per replicate and category from trios drawn within strata.

    ``trios``: strata, trio, by, n_mutations, denom (one row per trio and category).  Draws
    are reduced to multiplicities before they meet the counts.
    """
    strata = list(strata)
    trios = cut_lineage(trios)  # one row per trio and category, read by the draws and by the counts
    picks = (
        bootstrap_keys(trios, trio, n_rep, seed, strata)
        .groupBy(*strata, "rep", trio)
        .agg(F.count("*").alias("__times"))
    )
    return (
        picks.join(trios, [*strata, trio])
        .groupBy("rep", *by)
        .agg(
            F.sum(F.col("n_mutations") * F.col("__times")).alias("n"),
            F.sum(F.col("denom") * F.col("__times")).alias("denom"),
        )
        .withColumn("rate", F.when(F.col("denom") > 0, F.col("n") / (ploidy * F.col("denom"))))
    )


def bootstrap_hierarchical(loci: DataFrame, callable_bp: DataFrame, n_rep: int, seed: int) -> DataFrame:
    """Paternal and maternal rate per species and replicate.

    Families are drawn within the species, offspring within the drawn family and counted
    once; loci of the drawn offspring are kept once per draw.  An unphased locus becomes P
    with the phased share of the draw, or of the species where the draw has none.

    ``loci``: species, family, locus, child, phase (P, M or U), one row per child.
    ``callable_bp``: species, family, child, bp.
    """
    people = cut_lineage(callable_bp.groupBy("species", "family", "child").agg(F.sum("bp").alias("bp")))
    fams = bootstrap_keys(people, "family", n_rep, seed, ["species"]).withColumnRenamed("slot", "fam_slot")
    kids = cut_lineage(dense_index(people, "child", ["species", "family"]))
    sizes = kids.groupBy("species", "family").agg(F.count("*").alias("__n"))
    chosen = (
        fams.join(sizes, ["species", "family"])
        .withColumn("kid_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
        .withColumn(
            "idx",
            draw_index(
                F.col("__n"), F.lit(seed), F.lit("kid"), F.col("species"), F.col("rep"), F.col("fam_slot"), F.col("kid_slot")
            ),
        )
        .select("species", "rep", "fam_slot", "family", "idx")
        .distinct()
        .join(kids, ["species", "family", "idx"])
    )
    bases = (
        chosen.join(people, ["species", "family", "child"])
        .groupBy("species", "rep")
        .agg(F.sum("bp").alias("bp"))
    )
    phases = loci.groupBy("species", "family", "locus", "phase").agg(F.collect_set("child").alias("__carriers"))
    share = phases.groupBy("species").agg(
        (
            F.count_if(F.col("phase") == "P") / F.count_if(F.col("phase").isin("P", "M"))
        ).alias("__species_share")
    )
    # A locus is kept once per draw that has one of its carriers, so rows meet their draws in place.
    draws = (
        chosen.groupBy("species", "family", "rep", "fam_slot")
        .agg(F.collect_set("child").alias("kids"))
        .groupBy("species", "family")
        .agg(F.collect_list(F.struct("rep", "fam_slot", "kids")).alias("__draws"))
    )
    drawn = (
        lookup_join(phases, cut_lineage(draws), ["species", "family"])
        .withColumn("__draw", F.explode("__draws"))
        .filter(F.arrays_overlap("__carriers", "__draw.kids"))
        .select("species", "__draw.rep", "__draw.fam_slot", "locus", "phase")
    )
    pools = drawn.groupBy("species", "rep", "fam_slot").agg(
        (
            F.count_if(F.col("phase") == "P")
            / F.nullif(F.count_if(F.col("phase").isin("P", "M")), F.lit(0))
        ).alias("__share")
    )
    pools = cut_lineage(
        pools.join(share, "species").select(
            "species", "rep", "fam_slot", F.coalesce("__share", "__species_share").alias("__share")
        )
    )
    u = uniform(F.lit(seed), F.lit("phase"), F.col("species"), F.col("rep"), F.col("fam_slot"), F.col("locus"))
    paternal = (F.col("phase") == "P") | (
        (F.col("phase") == "U") & (u < F.col("__share"))
    )
    counts = (
        lookup_join(drawn, pools, ["species", "rep", "fam_slot"])
        .groupBy("species", "rep")
        .agg(F.count_if(paternal).alias("n_p"), F.count_if(~paternal).alias("n_m"))
    )
    denom = 2 * F.col("bp")
    return (
        bases.join(counts, ["species", "rep"], "left")
        .fillna(0, subset=["n_p", "n_m"])
        .withColumn("paternal_rate", F.when(denom > 0, F.col("n_p") / denom))
        .withColumn("maternal_rate", F.when(denom > 0, F.col("n_m") / denom))
    )


def _splits(m: int) -> list[tuple[int, int, int]]:
    """(from, middle, to) of every split of m categories, halves of a range after the range."""
    todo, out = [(0, m)], []
    while todo:
        lo, hi = todo.pop(0)
        if hi - lo > 1:
            middle = (lo + hi) // 2
            out.append((lo, middle, hi))
            todo += [(lo, middle), (middle, hi)]
    return out


@F.pandas_udf(ArrayType(LongType()))
def _split_draws(sizes: pd.Series, levels: pd.Series) -> pd.Series:
    """Multinomial draws by a tree of conditional binomials; rows with as many categories go together."""
    out = np.empty(len(sizes), dtype=object)
    length = sizes.map(len).to_numpy()
    for m in np.unique(length):
        rows = np.flatnonzero(length == m)
        n = np.stack([np.asarray(sizes.iloc[i], np.float64) for i in rows])
        u = np.stack([np.asarray(levels.iloc[i], np.float64) for i in rows])
        upto = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(n, axis=1)], axis=1)
        held = {(0, m): upto[:, m]}
        for lo, middle, hi in _splits(int(m)):
            whole = held.pop((lo, hi))
            part = binomial_quantile(whole, upto[:, middle] - upto[:, lo], upto[:, hi] - upto[:, middle], u[:, middle - 1])
            held[(lo, middle)], held[(middle, hi)] = part.astype(float), whole - part
        drawn = np.stack([held[(i, i + 1)] for i in range(int(m))], axis=1).astype(np.int64)
        for i, row in zip(rows, drawn):
            out[i] = row
    return pd.Series(out)


def bootstrap_multinomial(counts: DataFrame, keys: list[str], category: str, n: str, n_rep: int, seed: int) -> DataFrame:
    """(keys, rep, category, draws, share): multinomial resamples of the observed counts.

    The categories, in order, are halved again and again; at each split the draws that go to the
    left half are one binomial, the exact quantile of one hash draw labelled (seed, keys, rep,
    middle).  So the cost grows with the categories and not with the counts, small and large
    totals follow one rule, and only the aggregated counts are shuffled.
    """
    per = counts.groupBy(*keys, category).agg(F.sum(n).alias("__n"))
    cells = F.sort_array(F.collect_list(F.struct(F.col(category).alias("c"), F.col("__n").alias("n"))))
    arrays = per.groupBy(*keys).agg(F.sum("__n").alias("total"), cells.alias("cells")).filter("total > 0")
    labels = [F.lit(seed), *[F.col(k) for k in keys], F.col("rep")]
    middles = F.when(F.size("cells") > 1, F.sequence(F.lit(1), F.size("cells") - 1)).otherwise(F.array().cast("array<int>"))
    drawn = with_replicates(arrays, n_rep).withColumn(
        "__d", _split_draws(F.transform("cells", lambda c: c["n"]), F.transform(middles, lambda i: uniform(*labels, i)))
    )
    return (
        drawn.select(*keys, "rep", "total", F.explode(F.arrays_zip("cells", F.col("__d").alias("d"))).alias("x"))
        .filter("x.cells.n > 0")
        .select(
            *keys,
            "rep",
            F.col("x.cells.c").alias(category),
            F.col("x.d").alias("draws"),
            (F.col("x.d") / F.col("total")).alias("share"),
        )
    )


# --- null models --------------------------------------------------------------------------


def poisson_draw(lam: Column, u: Column) -> Column:
    """Smallest k with P(X <= k) >= u for a Poisson mean, by bisection on whole columns."""

    @F.pandas_udf("bigint")
    def quantile(mean: pd.Series, level: pd.Series) -> pd.Series:
        m, p = mean.to_numpy(float), level.to_numpy(float)
        lo = np.full(len(m), -1.0)
        hi = np.ceil(m + 12 * np.sqrt(m) + 40)
        while np.any(hi - lo > 1):
            mid = np.floor((lo + hi) / 2)
            reached = np.where(m > 0, gammaincc(mid + 1, m), 1.0) >= p
            hi, lo = np.where(reached, mid, hi), np.where(reached, lo, mid)
        return pd.Series(hi.astype("int64"))

    return quantile(lam.cast("double"), u.cast("double"))


def poisson_null(units: DataFrame, by: list[str], unit: str, n_rep: int, seed: int, group: str | None = None, ploidy: int = 2) -> DataFrame:
    """Variance and coefficient of variation of rates under one pooled Poisson rate.

    ``units``: by, unit, unique_dnms, callable_sites.  With ``group`` counts are drawn per
    unit and summed per group (individuals drawn, families compared).
    """
    units = cut_lineage(units)
    pooled = units.groupBy(*by).agg(
        (F.sum("unique_dnms") / (ploidy * F.sum("callable_sites"))).alias("__rate")
    )
    lam = ploidy * F.col("callable_sites") * F.col("__rate")
    u = uniform(F.lit(seed), *[F.col(b) for b in by], F.col("rep"), F.col(unit))
    drawn = with_replicates(units.join(pooled, by), n_rep).withColumn("k", poisson_draw(lam, u))
    level = group or unit
    rates = (
        drawn.groupBy(*by, "rep", level)
        .agg(F.sum("k").alias("k"), F.sum("callable_sites").alias("c"))
        .withColumn("r", F.col("k") / (ploidy * F.col("c")))
    )
    mean = F.avg("r")
    return rates.groupBy(*by, "rep").agg(
        F.var_pop("r").alias("variance"),
        F.when(mean > 0, F.stddev_pop("r") / mean).otherwise(F.lit(0.0)).alias("cv"),
    )


def pair_contrast(null: DataFrame, observed: DataFrame, pairs: DataFrame, value: str = "cv") -> DataFrame:
    """Sister pairs: observed difference first - second and its upper-tail p-value.

    ``null``: species, rep, value.  ``observed``: species, value.  ``pairs``: first, second.
    """
    side = lambda df, name: df.withColumnsRenamed({"species": name, value: f"__{name}"})
    sims = pairs.join(side(null.select("species", "rep", value), "first"), "first").join(
        side(null.select("species", "rep", value), "second"), ["second", "rep"]
    )
    obs = pairs.join(side(observed.select("species", value), "first"), "first").join(
        side(observed.select("species", value), "second"), "second"
    )
    delta = F.col("__first") - F.col("__second")
    seen = obs.select("first", "second", delta.alias("delta"))
    return (
        sims.select("first", "second", "rep", delta.alias("__sim"))
        .join(seen, ["first", "second"])
        .groupBy("first", "second", "delta")
        .agg(
            F.avg((F.col("__sim") >= F.col("delta")).cast("double")).alias("p_upper"),
            F.count("*").alias("n_sim"),
        )
    )


def group_contrast(null: DataFrame, observed: DataFrame, species: DataFrame, value: str = "cv") -> DataFrame:
    """Mean of subsocial minus mean of social species against the replicates."""
    gap = F.avg(F.when(F.col("sociality") == "subsocial", F.col(value))) - F.avg(
        F.when(F.col("sociality") == "social", F.col(value))
    )
    dim = species.select("species", "sociality")
    sims = null.join(dim, "species").groupBy("rep").agg(gap.alias("__sim"))
    seen = observed.join(dim, "species").agg(gap.alias("delta"))
    return sims.join(F.broadcast(seen)).groupBy("delta").agg(
        F.avg((F.col("__sim") >= F.col("delta")).cast("double")).alias("p_upper"),
        F.count("*").alias("n_sim"),
    )


def combined_sign(null: DataFrame, pairs: DataFrame, value: str = "cv") -> DataFrame:
    """Share of replicates in which every pair has first > second."""
    side = lambda name: null.select(F.col("species").alias(name), "rep", F.col(value).alias(f"__{name}"))
    each = pairs.join(side("first"), "first").join(side("second"), ["second", "rep"])
    per_rep = each.groupBy("rep").agg(F.bool_and(F.col("__first") > F.col("__second")).alias("__all"))
    return per_rep.agg(F.avg(F.col("__all").cast("double")).alias("p_all_positive"))


def interval_offsets(spans_: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Cumulative offsets [lo, hi) of disjoint spans laid end to end, chromosome by chromosome."""
    sized = spans_.withColumn("__len", F.col(end) - F.col(start))
    run = running(sized, ["chrom"], start, position_bucket(start, 1 << 20), {"__cum": ("sum", "__len")})
    chroms = range_buckets(sized.groupBy("chrom").agg(F.sum("__len").alias("__total")), "chrom")
    before = running(chroms, [], "chrom", F.col("__range"), {"__base": ("sum", "__total")}, inclusive=False)
    base = before.select("chrom", F.coalesce("__base", F.lit(0)).alias("__base"))
    hi = F.col("__base") + F.col("__cum")
    return run.join(base, "chrom").select(
        F.col("chrom"), F.col(start), (hi - F.col("__len")).alias("lo"), hi.alias("hi")
    )


def uniform_interval_null(spans_: DataFrame, n_points: DataFrame, n_rep: int, seed: int, start: str = "start", end: str = "end") -> DataFrame:
    """Mean nearest-neighbour distance of uniformly placed points, per replicate.

    ``spans_`` are disjoint.  ``n_points``: one row with column ``n``.  An offset is drawn in
    [0, total length) and found in the cumulative offsets by a binned range join.

    Points are drawn in blocks dealt out over tasks.  The planner takes them for as few as the row
    they are counted in, so the join is told to sort: a broadcast would gather them all.
    """
    offsets = cut_lineage(interval_offsets(cut_lineage(spans_), start, end))
    total = offsets.agg(F.max("hi").alias("__total"))
    slots = (
        with_replicates(n_points.select("n").join(F.broadcast(total)), n_rep)
        .withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 10000))))
        .repartition(DRAW_TASKS, "rep", "__b")
        .withColumn(
            "slot",
            F.explode(F.sequence(F.col("__b") * 10000, F.least(F.col("__b") * 10000 + 10000, F.col("n")) - 1)),
        )
        .withColumn("off", draw_index(F.col("__total"), F.lit(seed), F.col("rep"), F.col("slot")))
        .select("rep", "slot", "off")
    )
    placed = spans.point_in_span(slots.hint("merge"), offsets, [], "off", "lo", "hi", width=1 << 16)
    points = placed.select("rep", "chrom", (F.col(start) + F.col("off") - F.col("lo")).alias("pos"))
    return mean_nearest_neighbour(points, ["rep", "chrom"], ["rep"], "pos")


# --- branch lengths --------------------------------------------------------------------------


def three_point_branches(reps: DataFrame, keys: list[str], ab: str, ac: str, bc: str, pair: str = "pair", value: str = "ds") -> DataFrame:
    """Branch lengths of A, B and C to the central node; replicates need all three pairs."""
    wide = (
        reps.groupBy(*keys)
        .pivot(pair, [ab, ac, bc])
        .agg(F.first(value))
        .withColumnsRenamed({ab: "__ab", ac: "__ac", bc: "__bc"})
        .filter("__ab IS NOT NULL AND __ac IS NOT NULL AND __bc IS NOT NULL")
    )
    x, y, z = F.col("__ab"), F.col("__ac"), F.col("__bc")
    return wide.select(
        *keys,
        ((x + y - z) / 2).alias("l_a"),
        ((x + z - y) / 2).alias("l_b"),
        ((y + z - x) / 2).alias("l_c"),
    )


def lineage_contrast(branches: DataFrame, keys: list[str], social: str = "l_a", other: str = "l_b") -> DataFrame:
    """Difference other - social and 1 - social/other (NULL unless other > 0), summarised."""
    s, o = F.col(social), F.col(other)
    both = branches.select(
        *keys, (o - s).alias("abs_diff"), F.when(o > 0, 1 - s / o).alias("rel_short")
    )
    return replicate_summaries(both.withColumn("__all", F.lit("all")), ["__all"], ["abs_diff", "rel_short"]).drop("__all")
