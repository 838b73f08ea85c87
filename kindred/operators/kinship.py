"""Pairs of individuals: identity by state, relationship classes and their agreement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls as fc
from ..functions import ids
from ..plans.gram import pair_sums
from ..plans.running import position_bucket


def dosage(gt: str | Column) -> Column:
    """Number of alternate alleles, NULL when not a diploid two-allele call."""
    label = fc.genotype_class(gt)
    return F.when(label == "hom_ref", 0).when(label == "het", 1).when(label == "hom_alt", 2)


def _ibs0(m):
    ref, alt = (m == 0).astype(float), (m == 2).astype(float)
    cross = ref.T @ alt
    return cross + cross.T


def _both(m):
    called = (~np.isnan(m)).astype(float)
    return called.T @ called


def _het_both(m):
    het = (m == 1).astype(float)
    return het.T @ het


def _het_sum(m):
    het, called = (m == 1).astype(float), (~np.isnan(m)).astype(float)
    one = het.T @ called
    return one + one.T


def pairwise_ibs(calls: DataFrame, sites_per_block: int = 4096, entity_blocks: int | None = None) -> DataFrame:
    """Per pair of samples: shared sites, IBS0 share and the robust kinship coefficient
    (het-het minus twice opposite homozygotes, over the heterozygotes of both)."""
    rows = calls.select("sample", "chrom", "pos", dosage("gt").alias("d")).filter("d IS NOT NULL")
    sums = pair_sums(
        rows,
        "sample",
        F.concat_ws(":", "chrom", F.col("pos").cast("string")),
        F.xxhash64("chrom", position_bucket("pos", sites_per_block)),
        F.col("d"),
        {"n_snp": _both, "n_ibs0": _ibs0, "n_het_both": _het_both, "n_het_sum": _het_sum},
        entity_blocks,
    )
    n = F.col("n_snp")
    return sums.select(
        F.col("a").alias("id1"),
        F.col("b").alias("id2"),
        n.cast("bigint").alias("n_snp"),
        F.when(n > 0, F.col("n_ibs0") / n).alias("ibs0"),
        F.when(
            F.col("n_het_sum") > 0,
            (F.col("n_het_both") - 2 * F.col("n_ibs0")) / F.col("n_het_sum"),
        ).alias("kinship"),
    ).filter("n_snp > 0")


def unordered(df: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """Pair columns in alphabetical order."""
    return df.withColumn("__a", F.least(a, b)).withColumn("__b", F.greatest(a, b)).drop(a, b).withColumnsRenamed(
        {"__a": a, "__b": b}
    )


def join_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of the pairs of two tables with the values of both sides (NULL where absent)."""
    return unordered(left).join(unordered(right), ["id1", "id2"], "full_outer")


def known_relationship(a: str, b: str) -> Column:
    """Relationship that the sample names state."""
    role_a, role_b = ids.kin_role(a), ids.kin_role(b)
    return (
        F.when(ids.sample_family(a) != ids.sample_family(b), "unrelated")
        .when((role_a == "parent") & (role_b == "parent"), "unrelated")
        .when((role_a == "unknown") | (role_b == "unknown"), "unknown")
        .when(role_a != role_b, "parent-offspring")
        .otherwise("full-sibling")
    )


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """Inferred and known class of each pair, and whether they agree."""
    return (
        pairs.withColumn("inferred", fc.degree_of_kinship("kinship", "ibs0"))
        .withColumn("known", known_relationship("id1", "id2"))
        .withColumn("agree", F.col("inferred") == F.col("known"))
    )


def agreement(classified: DataFrame) -> DataFrame:
    """Agreement rate per known class, unknown pairs left out."""
    return (
        classified.filter("known <> 'unknown'")
        .groupBy("known")
        .agg(
            F.count("*").alias("n_pairs"),
            F.count_if("agree").alias("n_agree"),
            F.avg(F.col("agree").cast("double")).alias("agreement"),
        )
    )
