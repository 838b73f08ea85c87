"""Loci, sharing between siblings, parental phase and rates per family and individual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.spine import with_categories

LOCUS = ["species", "family", "chrom", "pos", "ref", "alt"]
PHASES = ("P", "M", "U", "F", "CONFLICT")


def locus_phase(on_conflict: str = "label", phase: str = "phased") -> Column:
    """Phase of a locus as an aggregate: P or M wins over U, F only counts when alone.

    ``on_conflict``: 'label' gives CONFLICT, 'raise' fails on execution.
    """
    p = F.col(phase)
    has = {k: F.bool_or(p == k) for k in ("P", "M", "U")}
    conflict = (
        F.raise_error(F.lit("paternal and maternal labels at one locus")).cast("string")
        if on_conflict == "raise"
        else F.lit("CONFLICT")
    )
    return (
        F.when(has["P"] & has["M"], conflict)
        .when(has["P"], "P")
        .when(has["M"], "M")
        .when(has["U"], "U")
        .otherwise("F")
    )


def loci(dnm: DataFrame, on_conflict: str = "label", drop_f: bool = False, key: list[str] | None = None) -> DataFrame:
    """One row per locus: number of children, sharing class and phase."""
    rows = dnm.filter("phased <> 'F'") if drop_f else dnm
    return rows.groupBy(*(key or LOCUS)).agg(
        F.count_distinct("child").alias("n_children"),
        locus_phase(on_conflict).alias("phase"),
    ).withColumn("sharing", F.when(F.col("n_children") >= 2, "shared").otherwise("unique"))


def sharing_summary(dnm: DataFrame, species: DataFrame, excluded: list[str]) -> DataFrame:
    """Loci seen in one or several siblings, and row, family and offspring counters."""
    keep = ~F.col("child").isin(*excluded) & (F.col("phased") != "F")
    rows = dnm.groupBy("species").agg(
        F.count_if(keep).alias("n_rows_included"), F.count_if(~keep).alias("n_rows_excluded")
    )
    included = dnm.filter(keep)
    people = included.select("species", "family", "child").distinct().groupBy("species").agg(
        F.count_distinct("family").alias("n_families"), F.count_distinct("child").alias("n_offspring")
    )
    counted = loci(included).groupBy("species").agg(
        F.count_if(F.col("sharing") == "unique").alias("n_unique"),
        F.count_if(F.col("sharing") == "shared").alias("n_shared"),
        F.count("*").alias("n_loci"),
    )
    out = species.select("species")
    for part in (rows, people, counted):
        out = out.join(part, "species", "left")
    return out.fillna(0)


def sharing_by_class(locus_table: DataFrame, species: DataFrame, group: str = "sociality") -> DataFrame:
    """Shared and unique loci pooled over the species of a class, with the shared fraction."""
    per_species = locus_table.groupBy("species").agg(
        F.count_if(F.col("sharing") == "shared").alias("n_shared"),
        F.count_if(F.col("sharing") == "unique").alias("n_unique"),
    )
    return (
        per_species.join(species.select("species", group), "species")
        .groupBy(group)
        .agg(F.sum("n_shared").alias("n_shared"), F.sum("n_unique").alias("n_unique"))
        .withColumn("shared_fraction", F.col("n_shared") / (F.col("n_shared") + F.col("n_unique")))
    )


def with_sharing(dnm: DataFrame, key: list[str]) -> DataFrame:
    """Add ``n_offspring`` and ``sharing`` to every row (a grouped transform)."""
    n = dnm.groupBy(*key).agg(F.count_distinct("child").alias("n_offspring"))
    return dnm.join(n, key).withColumn(
        "sharing", F.when(F.col("n_offspring") > 1, "shared").otherwise("unique")
    )


def phase_breakdown(locus_table: DataFrame) -> DataFrame:
    """Phases per species x sharing class plus OVERALL rows, with P/M and a sum check.

    One aggregation of the loci; the overall rows add up its small result.
    """
    base = locus_table.groupBy("species", "sharing").agg(
        *[F.count_if(F.col("phase") == k).alias(f"n_{k}") for k in PHASES],
        F.count("*").alias("n_total"),
    )
    measures = [f"n_{k}" for k in PHASES] + ["n_total"]
    overall = (
        base.groupBy("sharing")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .withColumn("species", F.lit("OVERALL"))
    )
    total = sum((F.col(f"n_{k}") for k in PHASES[1:]), F.col("n_P"))
    return (
        base.unionByName(overall)
        .withColumn("bias", F.when(F.col("n_M") > 0, F.col("n_P") / F.col("n_M")))
        .withColumn("sums_match", total == F.col("n_total"))
    )


def species_spine_counts(locus_table: DataFrame, species: DataFrame) -> DataFrame:
    """Phase counts for every species and sharing class, zero filled, in leaf order."""
    base = with_categories(species.select("species", "leaf_order"), ("unique", "shared"), "sharing")
    counts = locus_table.groupBy("species", "sharing").agg(
        *[F.count_if(F.col("phase") == k).alias(f"n_{k}") for k in ("P", "M", "U")],
        F.count("*").alias("n_loci"),
    )
    return base.join(counts, ["species", "sharing"], "left").fillna(0)


def parental_rates(locus_table: DataFrame, callable_bp: DataFrame) -> DataFrame:
    """Paternal and maternal rate per species: unphased loci follow the family's share of P,
    or the species' share where the family has no phased locus."""
    fam = locus_table.groupBy("species", "family").agg(
        *[F.count_if(F.col("phase") == k).alias(k.lower()) for k in ("P", "M", "U")]
    )
    sp = fam.groupBy("species").agg(
        (F.sum("p") / (F.sum("p") + F.sum("m"))).alias("species_share")
    )
    share = F.coalesce(F.col("p") / F.when(F.col("p") + F.col("m") > 0, F.col("p") + F.col("m")), F.col("species_share"))
    assigned = (
        fam.join(sp, "species")
        .withColumn("__s", share)
        .groupBy("species")
        .agg(
            F.sum("p").alias("n_p"),
            F.sum("m").alias("n_m"),
            F.sum("u").alias("n_u"),
            F.sum(F.col("p") + F.col("u") * F.col("__s")).alias("paternal"),
            F.sum(F.col("m") + F.col("u") * (1 - F.col("__s"))).alias("maternal"),
        )
    )
    bp = callable_bp.groupBy("species").agg(F.sum("bp").alias("callable_bp"))
    denom = 2 * F.col("callable_bp")
    return (
        assigned.join(bp, "species")
        .withColumn("paternal_rate", F.when(denom > 0, F.col("paternal") / denom))
        .withColumn("maternal_rate", F.when(denom > 0, F.col("maternal") / denom))
    )


def unit_rates(
    dnm: DataFrame, callable_bp: DataFrame, unit: list[str], key: list[str], ploidy: int = 2
) -> DataFrame:
    """Unique mutations per callable base for families or individuals.

    Starts from the callable table: a unit without mutations has rate 0, one without
    callable bases is left out.
    """
    bp = callable_bp.groupBy(*unit).agg(F.sum("bp").alias("callable_sites")).filter("callable_sites > 0")
    n = dnm.select(*dict.fromkeys([*unit, *key])).distinct().groupBy(*unit).agg(F.count("*").alias("unique_dnms"))
    return (
        bp.join(n, unit, "left")
        .fillna(0, subset=["unique_dnms"])
        .withColumn("rate", F.col("unique_dnms") / (ploidy * F.col("callable_sites")))
    )


def rate_dispersion(units: DataFrame, by: list[str], ploidy: int = 2) -> DataFrame:
    """Pooled rate, population variance and coefficient of variation over the units."""
    mean = F.avg("rate")
    return units.groupBy(*by).agg(
        F.count("*").alias("n_units"),
        F.sum("unique_dnms").alias("total_dnms"),
        F.sum("callable_sites").alias("total_callable"),
        (F.sum("unique_dnms") / (ploidy * F.sum("callable_sites"))).alias("pooled_rate"),
        F.var_pop("rate").alias("variance"),
        F.when(mean > 0, F.stddev_pop("rate") / mean).otherwise(F.lit(0.0)).alias("cv"),
    )


def _family_keys(sample: str):
    return [
        F.regexp_extract(sample, "^([^_]*)", 1),
        ids.natural_key(sample, "family"),
        ids.natural_key(sample, "_S"),
        F.col(sample),
    ]


def family_order(df: DataFrame, sample: str) -> DataFrame:
    """Natural order of family number, then offspring number."""
    return df.orderBy(*_family_keys(sample))


def with_family_place(samples: DataFrame, sample: str) -> DataFrame:
    """Place 1..n of each sample of a sample table in natural order."""
    return samples.withColumn(
        "place", F.row_number().over(W.orderBy(*_family_keys(sample))).cast("bigint")
    )
