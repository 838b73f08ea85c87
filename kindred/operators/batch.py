"""Sequencing lanes, flowcell occupancy and family structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids

GB = 1024.0**3
LANE_KEYS = ["species", "family", "individual"]


def lane_sizes(files: DataFrame, size: str = "bytes") -> DataFrame:
    """Size per individual, run and lane, plus a TOTAL row per individual."""
    lanes = files.groupBy(*LANE_KEYS, "round_id", "lane").agg(F.sum(size).alias("bytes"))
    total = lanes.groupBy(*LANE_KEYS).agg(F.sum("bytes").alias("bytes"))
    total = total.withColumn("round_id", F.lit("TOTAL")).withColumn("lane", F.lit("TOTAL"))
    return lanes.unionByName(total).withColumn("size_gb", F.col("bytes") / GB)


def coverage_from_bytes(sizes: DataFrame, genome: DataFrame) -> DataFrame:
    """Bytes over the genome size of the species; NULL without a size."""
    return sizes.join(genome.select("species", "genome_size"), "species", "left").withColumn(
        "coverage", F.when(F.col("genome_size") > 0, F.col("bytes") / F.col("genome_size"))
    )


def lanes_only(lanes: DataFrame) -> DataFrame:
    return lanes.filter("round_id <> 'TOTAL'")


def with_labels(lanes: DataFrame, social: list[str]) -> DataFrame:
    """Add role and sociality; one row per (flowcell, individual, family)."""
    return (
        lanes_only(lanes)
        .select("round_id", *LANE_KEYS)
        .distinct()
        .withColumn("role", ids.batch_role("individual"))
        .withColumn("sociality", ids.sociality("species", social))
    )


def batch_occupancy(labelled: DataFrame) -> DataFrame:
    """Distinct individuals, families, species, roles and classes per flowcell.

    Each count is a chain of narrowing groupings: no row is multiplied per distinct count.
    """
    role, soc = F.col("role"), F.col("sociality")
    people = (
        labelled.groupBy("round_id", "individual")
        .agg(F.min("role").alias("role"))
        .groupBy("round_id")
        .agg(
            F.count("*").alias("n_individuals"),
            (F.max((role == "parent").cast("bigint")) + F.max((role == "proband").cast("bigint"))).alias("n_roles"),
            F.max("role").alias("any_role"),
        )
    )
    families = (
        labelled.groupBy("round_id", "species", "family")
        .agg(F.min("sociality").alias("sociality"))
        .groupBy("round_id", "species")
        .agg(F.count("*").alias("__f"), F.min("sociality").alias("sociality"))
        .groupBy("round_id")
        .agg(
            F.sum("__f").alias("n_families"),
            F.count("*").alias("n_species"),
            (F.max((soc == "Social").cast("bigint")) + F.max((soc != "Social").cast("bigint"))).alias("n_classes"),
        )
    )
    return people.join(families, "round_id").select(
        "round_id", "n_individuals", "n_families", "n_species", "n_roles", "n_classes", "any_role"
    )


def occupancy_summary(occupancy: DataFrame) -> DataFrame:
    """One row: flowcells, single and mixed counts, spread of individuals per flowcell.

    The median comes from the count-of-counts table.
    """
    hist = occupancy.groupBy("n_individuals").agg(F.count("*").alias("n"))
    spread = hist.agg(
        F.min("n_individuals").alias("min_individuals"),
        F.percentile("n_individuals", F.lit(0.5), F.col("n")).alias("median_individuals"),
        (F.sum(F.col("n_individuals") * F.col("n")) / F.sum("n")).alias("mean_individuals"),
        F.max("n_individuals").alias("max_individuals"),
    )
    counts = occupancy.agg(
        F.count("*").alias("n_flowcells"),
        F.count_if(F.col("n_species") == 1).alias("single_species"),
        F.count_if(F.col("n_families") == 1).alias("single_family"),
        F.count_if(F.col("n_classes") == 1).alias("single_class"),
        F.count_if(F.col("n_individuals") == 1).alias("single_individual"),
        F.count_if((F.col("n_roles") == 1) & (F.col("any_role") == "parent")).alias("parent_only"),
        F.count_if((F.col("n_roles") == 1) & (F.col("any_role") == "proband")).alias("proband_only"),
        F.count_if(F.col("n_roles") > 1).alias("mixed_role"),
    )
    return counts.join(F.broadcast(spread))  # both are one row


def spread(table: DataFrame, column: str) -> DataFrame:
    """Minimum, median, mean and maximum of a count column, from its count-of-counts."""
    hist = table.groupBy(column).agg(F.count("*").alias("n"))
    v, n = F.col(column), F.col("n")
    return hist.agg(
        F.min(v).alias("min"),
        F.percentile(v, F.lit(0.5), n).alias("median"),
        (F.sum(v * n) / F.sum(n)).alias("mean"),
        F.max(v).alias("max"),
    ).select(F.lit(column).alias("measure"), "min", "median", "mean", "max")


def flowcells_per_family(labelled: DataFrame) -> DataFrame:
    return (
        labelled.select("species", "family", "round_id")
        .distinct()
        .groupBy("species", "family")
        .agg(F.count("*").alias("flowcells_per_family"))
    )


def count_of_counts(occupancy: DataFrame, column: str) -> DataFrame:
    return occupancy.groupBy(column).agg(F.count("*").alias("n_flowcells"))


def coassignment(labelled: DataFrame) -> DataFrame:
    """Families with a parent and a proband on one flowcell: the number of such flowcells."""
    return (
        labelled.groupBy("round_id", "species", "family")
        .agg(F.count_distinct("role").alias("roles"))
        .groupBy("species", "family")
        .agg(
            F.count_if(F.col("roles") > 1).alias("shared_flowcells"),
            F.count("*").alias("n_flowcells"),
        )
    )


def _joined(column: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(column)), ";")


def individual_batch_table(lanes: DataFrame, totals: DataFrame, social: list[str]) -> DataFrame:
    """One row per individual with sorted lists of families, flowcells and lanes.

    Values are reduced to distinct ones first, so a list is as long as it is printed.
    """
    rows = lanes_only(lanes)
    n = rows.groupBy("individual").agg(
        F.count("*").alias("n_lane_records"), F.min("species").alias("species")
    )
    lists = (
        rows.select("individual", "family", "round_id", "lane")
        .distinct()
        .groupBy("individual")
        .agg(
            _joined("family").alias("family"),
            _joined("round_id").alias("flowcell_ids"),
            F.count_distinct("round_id").alias("n_flowcells"),
            _joined("lane").alias("lanes"),
        )
    )
    return (
        n.join(lists, "individual")
        .join(totals.select("individual", F.round("coverage", 2).alias("total_coverage")), "individual", "left")
        .withColumn("role", ids.batch_role("individual"))
        .withColumn("sociality", ids.sociality("species", social))
    )


def batch_order(table: DataFrame) -> DataFrame:
    """sociality, species, family ascending; role descending; individual ascending."""
    return table.orderBy("sociality", "species", "family", F.desc("role"), "individual")


def family_slots(lanes: DataFrame) -> DataFrame:
    """Distinct (species, family, individual) with the role in the family."""
    return (
        lanes_only(lanes).select(*LANE_KEYS).distinct().withColumn("role", ids.family_role("individual"))
    )


def family_structure(slots: DataFrame, expected_offspring: int = 6) -> DataFrame:
    """Role counts per family with missing and surplus members."""
    role = F.col("role")
    f = slots.groupBy("species", "family").agg(
        *[F.count_if(role == r).alias(f"n_{r}") for r in ("father", "mother", "offspring")],
        F.count("*").alias("n_sequenced"),
    )
    lack = lambda want, have: F.greatest(F.lit(0).cast("bigint"), F.lit(want) - F.col(have))
    return (
        f.withColumn("missing_father", lack(1, "n_father"))
        .withColumn("missing_mother", lack(1, "n_mother"))
        .withColumn("missing_offspring", lack(expected_offspring, "n_offspring"))
        .withColumn(
            "n_missing", F.col("missing_father") + F.col("missing_mother") + F.col("missing_offspring")
        )
        .withColumn("n_surplus", F.greatest(F.lit(0).cast("bigint"), F.col("n_offspring") - expected_offspring))
        .withColumn("expected_total", F.lit(expected_offspring + 2).cast("bigint"))
        .withColumn("complete", F.when(F.col("n_missing") == 0, "yes").otherwise("no"))
    )


def species_structure(slots: DataFrame, families: DataFrame) -> DataFrame:
    """Unique individuals per species and the sums of the family table."""
    people = slots.select("species", "individual", "role").distinct()
    unique = people.groupBy("species").agg(
        *[
            F.count_if(F.col("role") == r).alias(f"n_{r}_unique")
            for r in ("father", "mother", "offspring")
        ],
        F.count("*").alias("n_sequenced_unique"),
    )
    sums = families.groupBy("species").agg(
        F.count("*").alias("n_families"),
        F.sum("expected_total").alias("expected_total"),
        F.sum("n_missing").alias("n_missing"),
        F.sum("n_surplus").alias("n_surplus"),
    )
    return unique.join(sums, "species")


def overall_structure(slots: DataFrame, families: DataFrame) -> DataFrame:
    """metric / value rows over everything, with the number of shared parents."""
    per = slots.groupBy("individual").agg(F.count("*").alias("n"), F.min("role").alias("role"))
    people = per.agg(
        F.count("*").alias("n_sequenced_unique_individuals"),
        F.count_if(F.col("role") != "offspring").alias("n_parents_unique"),
        F.count_if(F.col("role") == "offspring").alias("n_offspring_unique"),
        F.count_if(F.col("n") > 1).alias("n_shared_parents"),
    )
    sums = families.agg(
        F.count_distinct("species").alias("n_species"),
        F.count("*").alias("n_families"),
        F.sum("n_sequenced").alias("n_family_slot_records"),
        F.sum("expected_total").alias("expected_total_slots"),
        F.sum("n_missing").alias("n_missing"),
        F.sum(F.col("missing_father") + F.col("missing_mother")).alias("n_missing_parents"),
        F.sum("missing_offspring").alias("n_missing_offspring"),
        F.sum("n_surplus").alias("n_surplus_offspring"),
    )
    wide = sums.join(F.broadcast(people))  # one row each
    return wide.unpivot([], wide.columns, "metric", "value")


def lane_coverage(lanes: DataFrame, by: list[str] = ("individual",), flowcell: str = "round_id", lane: str = "lane") -> DataFrame:
    """(by, flowcell, lane, coverage): one row per individual and lane that it was sequenced in.

    A lane is known by its flowcell and its number, so equal numbers on two flowcells stay apart,
    and no lane has to be listed beforehand.
    """
    return lanes_only(lanes).groupBy(*by, flowcell, lane).agg(F.sum("coverage").alias("coverage"))


def lane_matrix(
    lanes: DataFrame, columns: list[tuple[str, str]] | list[str], by: list[str] = ("individual",), flowcell: str = "round_id", lane: str = "lane"
) -> DataFrame:
    """Coverage by individual and the given (flowcell, lane) columns, named ``flowcell:lane``; 0 where absent.

    Columns may also be lanes alone; then ``by`` has the flowcell, so that every flowcell has its
    own rows.  Lanes outside the list are added up in ``others``.
    """
    alone = all(isinstance(c, str) for c in columns)
    if alone and flowcell not in by:
        raise ValueError(f"lanes of different flowcells would be added up: put {flowcell} into the rows")
    rows = lane_coverage(lanes, [b for b in by if b != flowcell], flowcell, lane)
    key = F.col(lane) if alone else F.concat_ws(":", flowcell, lane)
    names = list(columns) if alone else [f"{f}:{x}" for f, x in columns]
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("coverage"))), F.lit(0.0))
    return rows.groupBy(*by).agg(*[total(key == n).alias(n) for n in names], total(~key.isin(names)).alias("others"))
