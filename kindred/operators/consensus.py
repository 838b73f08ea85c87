"""Classification of consensus SNPs by read support, and allele selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import calls as fc
from ..plans.spans import bin_of, span_bins

BASES = ("A", "C", "G", "T")


def _walk(cigars: pd.Series) -> pd.Series:
    """Aligned blocks of each CIGAR text as [reference offset, read offset, length] triples, flat.

    All texts of a batch are read at once: numbers digit by digit, offsets as running sums that
    start again at each read.  M, = and X are aligned; D and N move on the reference, I and S on
    the read, H and P on neither.
    """
    raw = [(x or "*").encode() for x in cigars]
    size = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8) if raw else np.empty(0, np.uint8)
    digit = (data >= 48) & (data <= 57)
    at = np.flatnonzero(~digit)
    owner = np.repeat(np.arange(len(raw)), size)[at]
    first = np.r_[True, owner[1:] != owner[:-1]] if len(at) else np.empty(0, bool)
    begin = np.where(first, (np.cumsum(size) - size)[owner], np.r_[0, at[:-1] + 1]) if len(at) else at
    n = np.zeros(len(at), np.int64)
    for back in range(int((at - begin).max(initial=0)), 0, -1):
        more = at - begin >= back
        n[more] = n[more] * 10 + data[at[more] - back] - 48
    letter = data[at]
    moves = {w: n * np.isin(letter, np.frombuffer(w, np.uint8)) for w in (b"MDN=X", b"MIS=X", b"M=X")}
    start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else at

    def offset(step: np.ndarray) -> np.ndarray:
        before = np.cumsum(step) - step
        return before - before[start]

    aligned = moves[b"M=X"] > 0
    rows = np.stack([offset(moves[b"MDN=X"]), offset(moves[b"MIS=X"]), n], axis=1)[aligned]
    cut = np.searchsorted(owner[aligned], np.arange(1, len(raw)))
    return pd.Series([x.ravel() for x in np.split(rows, cut)][: len(raw)], index=cigars.index, dtype=object)


_blocks = F.pandas_udf(_walk, ArrayType(LongType()))


def aligned_blocks(reads: DataFrame, cigar: str | None = "cigar") -> DataFrame:
    """One row per aligned block: chrom, from and to (0-based, half-open), seq and base_quality of the block.

    ``reads``: chrom, pos (1-based start), seq, base_quality (one value, or an array per base)
    and ``cigar``; without a CIGAR column a read is one block.  A block carries its own part of
    the read, so the rows hold no more bases than the reads.  A missing CIGAR ('*') has no block.
    """
    per_base = dict(reads.dtypes)["base_quality"].startswith("array")
    start = (F.col("pos") - 1).cast("bigint")
    if cigar is None:
        return reads.filter(F.length("seq") > 0).select(
            "chrom", start.alias("from"), (start + F.length("seq")).alias("to"), "seq", "base_quality"
        )
    triples = F.transform(
        F.sequence(F.lit(1), F.size("__b"), F.lit(3)), lambda i: F.slice("__b", i, 3)
    )
    rows = (
        reads.select("chrom", start.alias("__from"), "seq", "base_quality", _blocks(F.col(cigar)).alias("__b"))
        .filter(F.size("__b") > 0)
        .withColumn("__x", F.explode(triples))
    )
    ref, own, n = (F.col("__x")[i] for i in range(3))
    quality = F.slice("base_quality", (own + 1).cast("int"), n.cast("int")) if per_base else F.col("base_quality")
    return rows.select(
        "chrom",
        (F.col("__from") + ref).alias("from"),
        (F.col("__from") + ref + n).alias("to"),
        F.substring(F.col("seq"), (own + 1).cast("int"), n.cast("int")).alias("seq"),
        quality.alias("base_quality"),
    )


def site_base_counts(
    reads: DataFrame, sites: DataFrame, min_base_quality: int = 20, width: int = 512,
    cigar: str | None = None, salts: int = 8,
) -> DataFrame:
    """Counts of A, C, G, T at the given sites (chrom, 1-based pos), from reads with or without gaps.

    Aligned blocks are cut at the edges of ``width`` bases, each piece with its own bases, and
    dealt over ``salts`` per bin; the sites of a bin, one row with at most ``width`` offsets, meet
    its pieces in each of them.  So reads are not repeated, a deep place is spread, and the rows
    are (piece, covered site) pairs.  The site rows are hashed, so the pieces need no sort.
    """
    per_base = dict(reads.dtypes)["base_quality"].startswith("array")
    if not per_base:
        reads = reads.filter(F.col("base_quality") >= min_base_quality)
    blocks = aligned_blocks(reads, cigar)
    lo = F.greatest("from", F.col("__bin") * width)
    hi = F.least("to", (F.col("__bin") + 1) * width)
    skip, n = (lo - F.col("from")).cast("int"), (hi - lo).cast("int")
    pieces = blocks.withColumn("__bin", F.explode(span_bins(F.col("from"), F.col("to"), width))).select(
        F.col("chrom").alias("__chrom"),
        F.col("__bin"),
        (lo - F.col("__bin") * width).cast("int").alias("__lo"),
        F.substring(F.col("seq"), skip + 1, n).alias("seq"),
        (F.slice("base_quality", skip + 1, n) if per_base else F.lit(None)).alias("base_quality"),
        F.pmod(F.xxhash64("from", "to", "seq"), F.lit(salts)).cast("int").alias("__salt"),
    )
    p0 = (F.col("pos") - 1).cast("bigint")
    wanted = (
        sites.select("chrom", bin_of(p0, width).alias("__sbin"), F.pmod(p0, F.lit(width)).cast("int").alias("__p"))
        .groupBy("chrom", "__sbin")
        .agg(F.collect_set("__p").alias("__sites"))
        .withColumn("__ssalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    on = (
        (F.col("chrom") == F.col("__chrom"))
        & (F.col("__sbin") == F.col("__bin"))
        & (F.col("__ssalt") == F.col("__salt"))
    )
    at = F.col("__p") - F.col("__lo")
    covered = (
        pieces.join(wanted.hint("shuffle_hash"), on)
        .withColumn("__p", F.explode("__sites"))
        .filter((at >= 0) & (at < F.length("seq")))
        .select(
            "chrom",
            (F.col("__bin") * width + F.col("__p") + 1).cast(dict(sites.dtypes)["pos"]).alias("pos"),
            F.upper(F.substring(F.col("seq"), at + 1, F.lit(1))).alias("base"),
            *(["base_quality", at.alias("__at")] if per_base else []),
        )
    )
    if per_base:
        covered = covered.filter(F.get("base_quality", F.col("__at")) >= min_base_quality)
    return (
        covered.filter(F.col("base").isin(*BASES))
        .groupBy("chrom", "pos")
        .agg(*[F.count_if(F.col("base") == b).alias(f"n_{b}") for b in BASES])
    )


def heterozygous_snps(snps: DataFrame) -> DataFrame:
    """The single-base heterozygotes: the only sites whose class depends on the reads."""
    simple = F.upper("ref").rlike("^[ACGT]$") & F.upper("alt").rlike("^[ACGT]$")
    return snps.filter(simple & fc.normalize_gt("gt").isin("0/1", "1/0"))


def classify_by_reads(snps: DataFrame, reads: DataFrame, **pileup) -> DataFrame:
    """``classify_snps`` with the pileup at heterozygous sites only."""
    return classify_snps(snps, site_base_counts(reads, heterozygous_snps(snps), **pileup))


def observed_bases():
    """Array of the bases with a count, from n_A .. n_T."""
    return F.filter(
        F.array(*[F.when(F.col(f"n_{b}") > 0, F.lit(b)) for b in BASES]), lambda x: x.isNotNull()
    )


def clean_support(ref, alt):
    """Observed bases are exactly REF and ALT."""
    seen = observed_bases()
    return (
        (F.size(F.array_except(seen, F.array(ref, alt))) == 0)
        & F.array_contains(seen, ref)
        & F.array_contains(seen, alt)
    )


def classify_snps(snps: DataFrame, base_counts: DataFrame) -> DataFrame:
    """Add ``classification`` and ``reason``: only heterozygotes need the base counts.

    ``snps``: chrom, pos, ref, alt, gt.
    """
    joined = snps.join(base_counts, ["chrom", "pos"], "left").fillna(
        0, subset=[f"n_{b}" for b in BASES]
    )
    ref, alt, gt = F.upper("ref"), F.upper("alt"), fc.normalize_gt("gt")
    simple = ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$")
    het = gt.isin("0/1", "1/0")
    seen = observed_bases()
    reason = (
        F.when(~simple, "non_simple_snp")
        .when(gt.isin("0/0", "0"), "pass_hom_ref")
        .when(gt.isin("1/1", "1"), "pass_hom_alt")
        .when(~F.coalesce(het, F.lit(False)), "invalid_gt")
        .when(F.size(seen) == 0, "no_valid_bases")
        .when(F.size(F.array_except(seen, F.array(ref, alt))) > 0, "third_base_support")
        .when(~F.array_contains(seen, ref), "missing_ref_support")
        .when(~F.array_contains(seen, alt), "missing_alt_support")
        .otherwise("pass_het_clean")
    )
    # Classification of each reason.
    label = (
        F.when(F.col("reason").isin("non_simple_snp", "invalid_gt"), "uncallable")
        .when(F.col("reason") == "pass_hom_ref", "hom_ref")
        .when(F.col("reason") == "pass_hom_alt", "hom_alt")
        .when(F.col("reason") == "pass_het_clean", "het_clean")
        .otherwise("het_unclean")
    )
    return joined.withColumn("reason", reason).withColumn("classification", label)


def classification_stats(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per class; the filtered fraction is computed from the merged counts."""
    c = F.col("classification")
    counts = classified.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[
            F.count_if(c == k).alias(k)
            for k in ("hom_ref", "hom_alt", "het_clean", "het_unclean", "uncallable")
        ],
    )
    het = F.col("het_clean") + F.col("het_unclean")
    return counts.withColumn("het_total", het).withColumn(
        "filtered_fraction", F.when(het > 0, F.col("het_unclean") / het).otherwise(F.lit(0.0))
    )


# Consensus modes.
MODES = ("using_alt", "using_ref", "random", "majority")


def select_alleles(classified: DataFrame, seed, species: str) -> DataFrame:
    """Action per site under every mode and support policy (strict, relaxed)."""
    grid = classified.withColumn("mode", F.explode(F.array(*map(F.lit, MODES)))).withColumn(
        "policy", F.explode(F.array(F.lit("strict"), F.lit("relaxed")))
    )
    ref_n, alt_n = fc.dp4_support("dp4")
    choice = fc.seeded_choice(seed, F.lit(species), "chrom", "pos")
    return grid.withColumn(
        "action",
        fc.resolve_allele(
            "classification", "mode", F.col("policy") == "relaxed", choice, ref_n, alt_n
        ),
    )


def rejected_bed(selected: DataFrame) -> DataFrame:
    """Half-open rows of the sites that could not be resolved."""
    return selected.filter("action = 'uncallable'").select(
        "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "mode", "policy"
    )


def alignment_errors(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not in both tables equally often, with the counts on each side."""
    left = a.groupBy(*keys).agg(F.count("*").alias("n_a"))
    right = b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    return (
        left.join(right, keys, "full_outer")
        .fillna(0, subset=["n_a", "n_b"])
        .filter("n_a <> n_b")
    )


def assert_aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` with the columns of ``b``; fails on execution when a key is missing."""
    right = b.withColumn("__b", F.lit(True))
    left = a.withColumn("__a", F.lit(True))
    joined = left.join(right, keys, "full_outer")
    broken = F.col("__a").isNull() | F.col("__b").isNull()
    shown = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    return (
        joined.withColumn(
            "__check", F.when(broken, F.raise_error(F.concat(F.lit("not aligned at "), shown)))
        )
        .filter("__check IS NULL")
        .drop("__a", "__b", "__check")
    )
