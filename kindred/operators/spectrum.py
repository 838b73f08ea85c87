"""Mutation classes, spectra, rates and fold changes.

Counting starts with one aggregation of the mutation rows by (stratum, label).  Everything
after it (overall rows, zero filling, denominators, groups) works on tables whose size is
strata x a fixed number of categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bases as fb
from ..functions.special import poisson_limits
from ..plans.cut import cut_lineage
from ..plans.spine import CLASSES8, SBS96, TRINUC32, dense_counts, with_categories

DNM_KEY = ["chrom", "pos", "ref", "alt", "father", "mother"]


def dedup_dnm(df: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: any row, or the first by ``order``.

    The ordered form is an aggregation (a minimum over a struct), so duplicates of a hot key
    collapse before the shuffle.
    """
    if not order:
        return df.dropDuplicates(key)
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("__r")
    )
    return first.select(*[F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in df.columns])


def keep_offspring(rows: DataFrame, callable_table: DataFrame, excluded: DataFrame, child: str = "child") -> DataFrame:
    """Rows of offspring that are callable and not excluded."""
    kept = callable_table.select(child).distinct().join(excluded, child, "left_anti")
    return rows.join(kept, child, "left_semi")


def labelled_germline(dnm: DataFrame) -> DataFrame:
    """Add ``mutation_class``, ``context`` (folded) and ``category`` from the flanking bases."""
    site = F.when(
        F.upper("nuc_ref") == F.upper("ref"),
        fb.folded_site("ref", "alt", "n_before", "nuc_after"),
    )
    return (
        dnm.withColumn("__site", site)
        .withColumn("mutation_class", fb.class7_of_site(F.col("__site")))
        .withColumn("context", F.substring("__site", 1, 3))
        .withColumn("category", fb.category_of_site(F.col("__site")))
        .drop("__site")
    )


def somatic_is_valid() -> Column:
    """Pyrimidine reference, three-base context with that centre, a different plain ALT."""
    ref, alt, ctx = F.col("oriented_ref"), F.col("oriented_alt"), F.col("oriented_context")
    return (
        fb.is_pyrimidine(ref)
        & (F.length(ctx) == 3)
        & (F.substring(ctx, 2, 1) == ref)
        & fb.is_base(alt)
        & (alt != ref)
    )


def labelled_somatic(rows: DataFrame) -> DataFrame:
    """Valid strand-oriented rows with class, context and category."""
    ctx = F.col("oriented_context")
    left, right = F.substring(ctx, 1, 1), F.substring(ctx, 3, 1)
    sub = F.concat("oriented_ref", F.lit(">"), "oriented_alt")
    return (
        rows.filter(somatic_is_valid())
        .withColumn(
            "mutation_class",
            F.when(sub == "C>T", F.when(right == "G", "C>T_CpG").otherwise("C>T_nonCpG")).otherwise(sub),
        )
        .withColumn("context", ctx)
        .withColumn("category", F.concat(left, F.lit("["), sub, F.lit("]"), right))
    )


def drop_counts(rows: DataFrame, strata: list[str]) -> DataFrame:
    return rows.groupBy(*strata).agg(
        F.count("*").alias("n_total"), F.count_if(~somatic_is_valid()).alias("n_skipped")
    )


def germline_drop_counts(dnm: DataFrame, kept: DataFrame, x_chroms: list[str], strata: list[str]) -> DataFrame:
    """Rows dropped per rule, first match, and the unique mutations that remain.

    ``kept``: offspring that are callable and not excluded.
    """
    flagged = labelled_germline(dnm).join(
        kept.select("child").distinct().withColumn("__kept", F.lit(True)), "child", "left"
    )
    rule = (
        F.when(F.col("chrom").isin(*x_chroms), "x")
        .when(F.col("__kept").isNull(), "offspring")
        .when(F.col("mutation_class").isNull(), "unclassified")
        .otherwise("used")
    )
    # one row per mutation and rule: duplicates collapse before the distinct count
    per = flagged.groupBy(*dict.fromkeys([*strata, *DNM_KEY]), rule.alias("__rule")).agg(
        F.count("*").alias("__n")
    )
    rows = lambda r: F.coalesce(F.sum(F.when(F.col("__rule") == r, F.col("__n"))), F.lit(0)).cast("bigint")
    return per.groupBy(*strata).agg(
        F.sum("__n").alias("n_total_rows"),
        rows("x").alias("n_dropped_x"),
        rows("offspring").alias("n_dropped_offspring"),
        rows("unclassified").alias("n_skipped_unclassified"),
        F.count_if(F.col("__rule") == "used").alias("n_unique"),
    )


def class_counts(labelled: DataFrame, strata: list[str]) -> DataFrame:
    """Counts of the seven classes and ``overall``, zero filled per stratum."""
    counts = labelled.groupBy(*strata, "mutation_class").agg(F.count("*").alias("n_mutations"))
    return dense_counts(
        counts, strata, "mutation_class", "n_mutations", CLASSES8, overall="overall"
    ).drop("total")


def class_denominators(trinuc: DataFrame, strata: list[str], n: str = "n") -> DataFrame:
    """Eight class denominators from folded context counts."""
    t, c = F.col("trinuc"), F.col(n)
    mid = F.substring(t, 2, 1)
    cpg = (mid == "C") & (F.substring(t, 3, 1) == "G")
    zero = F.lit(0).cast("bigint")
    sums = trinuc.groupBy(*strata).agg(
        F.coalesce(F.sum(c), zero).alias("all_"),
        F.coalesce(F.sum(F.when(mid == "C", c)), zero).alias("c_"),
        F.coalesce(F.sum(F.when(cpg, c)), zero).alias("cpg_"),
        F.coalesce(F.sum(F.when(mid == "T", c)), zero).alias("t_"),
    )
    # Denominator of each class.
    source = {
        "overall": F.col("all_"),
        "C>A": F.col("c_"),
        "C>G": F.col("c_"),
        "C>T_nonCpG": F.col("c_") - F.col("cpg_"),
        "C>T_CpG": F.col("cpg_"),
        "T>A": F.col("t_"),
        "T>C": F.col("t_"),
        "T>G": F.col("t_"),
    }
    rows = F.array(
        *[F.struct(F.lit(k).alias("mutation_class"), v.alias("denom")) for k, v in source.items()]
    )
    return sums.select(*strata, F.explode(rows).alias("d")).select(*strata, "d.*")


def rates(counts: DataFrame, denoms: DataFrame, on: list[str], ploidy: int = 2, limits: bool = True) -> DataFrame:
    """n / (ploidy·denom), with exact Poisson limits; NULL on a zero denominator."""
    out = counts.join(denoms, on)
    haploid = F.col("denom") * ploidy
    ok = haploid > 0
    out = out.withColumn("rate", F.when(ok, F.col("n_mutations") / haploid))
    if limits:
        out = (
            out.withColumn("__l", poisson_limits(F.col("n_mutations")))
            .withColumn("ci_low", F.when(ok, F.col("__l.low") / haploid))
            .withColumn("ci_high", F.when(ok, F.col("__l.high") / haploid))
            .drop("__l")
        )
    return out


def spectrum96(labelled: DataFrame, strata: list[str]) -> DataFrame:
    """96 ordered categories per stratum, zero filled, with the fraction of the total."""
    counts = labelled.groupBy(*strata, "category").agg(F.count("*").alias("n"))
    full = dense_counts(counts, strata, "category", "n", SBS96, rank="rank")
    return full.withColumn(
        "fraction", F.when(F.col("total") > 0, F.col("n") / F.col("total"))
    ).drop("total")


def context_of(category: str = "category") -> Column:
    """Three-base context of a category label."""
    return F.concat(F.substring(category, 1, 1), F.substring(category, 3, 1), F.substring(category, 7, 1))


def collapse7(spectrum: DataFrame, strata: list[str], n: str = "n") -> DataFrame:
    return spectrum.groupBy(*strata, fb.class7_of_category("category").alias("mutation_class")).agg(
        F.sum(n).alias("n")
    )


def context_spine(trinuc: DataFrame, strata: list[str]) -> DataFrame:
    """All 32 contexts per stratum, zero filled."""
    total = trinuc.groupBy(*strata, "trinuc").agg(F.sum("n").alias("n"))
    return dense_counts(total, strata, "trinuc", "n", TRINUC32).drop("total")


def pool_groups(table: DataFrame, members: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Sums over (overlapping) groups: a join to the membership table."""
    return (
        table.join(members, "species")
        .groupBy("group_name", *by)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def rate_master(
    germline: DataFrame, somatic: DataFrame, members: DataFrame, category: str = "mutation_class", limits: bool = True
) -> DataFrame:
    """Per species and pooled group x level x category: n, denominator, rate, limits.

    Inputs: (species, category, n_mutations, denom); germline denominators are diploid bases.
    They have one row per species and category, and are stored once for both ways to sum them.
    """
    cols = ["species", category, "n_mutations", "denom"]
    both = germline.select(*cols, F.lit("germline").alias("level"), F.lit(2).alias("ploidy")).unionByName(
        somatic.select(*cols, F.lit("somatic").alias("level"), F.lit(1).alias("ploidy"))
    )
    both = cut_lineage(both)
    single = both.withColumn("group_name", F.lit("per_species"))
    pooled = pool_groups(both, members, ["level", "ploidy", category], ["n_mutations", "denom"]).withColumn(
        "species", F.lit("merged")
    )
    out = single.unionByName(pooled)
    haploid = F.col("denom") * F.col("ploidy")
    ok = haploid > 0
    out = out.withColumn("rate", F.when(ok, F.col("n_mutations") / haploid))
    if limits:
        out = (
            out.withColumn("__l", poisson_limits(F.col("n_mutations")))
            .withColumn("ci_low", F.when(ok, F.col("__l.low") / haploid))
            .withColumn("ci_high", F.when(ok, F.col("__l.high") / haploid))
            .drop("__l")
        )
    return out.drop("ploidy")


def fold_change(germline: DataFrame, somatic: DataFrame, on: list[str]) -> DataFrame:
    """Somatic over germline rate with log2 and a 95% interval (empty when a count is 0)."""
    g = germline.select(*on, F.col("n_mutations").alias("n_g"), (F.col("denom") * 2).alias("d_g"))
    s = somatic.select(*on, F.col("n_mutations").alias("n_s"), F.col("denom").alias("d_s"))
    n_g, n_s, d_g, d_s = (F.col(c) for c in ("n_g", "n_s", "d_g", "d_s"))
    se = F.sqrt(1.0 / n_g + 1.0 / n_s)
    fc = F.col("fold_change")
    both = (n_g > 0) & (n_s > 0) & fc.isNotNull()
    return (
        g.join(s, on)
        .withColumn("germline_rate", F.when(d_g > 0, n_g / d_g))
        .withColumn("somatic_rate", F.when(d_s > 0, n_s / d_s))
        .withColumn(
            "fold_change",
            F.when(F.col("germline_rate") > 0, F.col("somatic_rate") / F.col("germline_rate")),
        )
        .withColumn("log2_fc", F.when(fc > 0, F.log2(fc)))
        .withColumn("fc_low", F.when(both, F.exp(F.log(fc) - 1.96 * se)))
        .withColumn("fc_high", F.when(both, F.exp(F.log(fc) + 1.96 * se)))
    )


def per_trio_long(
    callable_bp: DataFrame, labelled: DataFrame, trinuc: DataFrame, x_chroms: list[str], excluded: list[str]
) -> DataFrame:
    """species x offspring x chromosome x class: counts, class denominators, total bases.

    The rows come from the callable table.  X chromosomes have a denominator for ``overall``
    only, their callable bases; excluded trios stay with included = 'no'.
    """
    keys = ["species", "child", "chrom"]
    base = callable_bp.groupBy(*keys).agg(F.sum("bp").alias("callable_bp"))
    counts = class_counts(labelled, keys)
    denoms = class_denominators(trinuc.filter(~F.col("chrom").isin(*x_chroms)), keys)
    on = [*keys, "mutation_class"]
    is_x = F.col("chrom").isin(*x_chroms)
    return (
        with_categories(base, CLASSES8, "mutation_class")
        .join(counts, on, "left")
        .join(denoms, on, "left")
        .fillna(0, subset=["n_mutations"])
        .withColumn("chrom_group", F.when(is_x, "x_chromosome").otherwise("autosome"))
        .withColumn(
            "denom_bp",
            F.coalesce("denom", F.when(is_x & (F.col("mutation_class") == "overall"), F.col("callable_bp"))),
        )
        .withColumn("included", F.when(F.col("child").isin(*excluded), "no").otherwise("yes"))
        .drop("denom")
    )


def pooled_rate_rows(per_trio: DataFrame) -> DataFrame:
    """Autosomal, included rows pooled over all species."""
    return (
        per_trio.filter("chrom_group = 'autosome' AND included = 'yes' AND denom_bp IS NOT NULL")
        .groupBy("mutation_class")
        .agg(F.sum("n_mutations").alias("n_mutations"), (2 * F.sum("denom_bp")).alias("denom"))
        .withColumn("rate", F.when(F.col("denom") > 0, F.col("n_mutations") / F.col("denom")))
    )


def baseline_loo(table: DataFrame, by: list[str], n: str, member: Column) -> DataFrame:
    """Pooled baseline of the members per category; a member's own count is taken out."""
    total = table.filter(member).groupBy(*by).agg(F.sum(n).alias("__t"))
    return (
        table.join(total, by, "left")
        .withColumn(
            "baseline",
            F.coalesce("__t", F.lit(0)) - F.when(member, F.col(n)).otherwise(F.lit(0)),
        )
        .drop("__t")
    )


def direction_consistency(tests: DataFrame, by: list[str], effect: str, significant: str) -> DataFrame:
    """Significant ups and downs per category: all, partial or mixed_or_none."""
    sig = F.col(significant)
    n_sig = F.col("n_up") + F.col("n_down")
    one_way = (F.col("n_up") == 0) | (F.col("n_down") == 0)
    return (
        tests.groupBy(*by)
        .agg(
            F.count_if(sig & (F.col(effect) > 0)).alias("n_up"),
            F.count_if(sig & (F.col(effect) < 0)).alias("n_down"),
            F.count("*").alias("n_total"),
        )
        .withColumn(
            "consistent",
            F.when((n_sig == F.col("n_total")) & one_way, "all")
            .when((n_sig > 0) & one_way, "partial")
            .otherwise("mixed_or_none"),
        )
    )


def sign_agreement(pairs: DataFrame, by: list[str], effect: str) -> DataFrame:
    """Whether an effect has the same sign in every pair."""
    return (
        pairs.groupBy(*by)
        .agg(
            F.count_if(F.col(effect) > 0).alias("pairs_pos"),
            F.count_if(F.col(effect) < 0).alias("pairs_neg"),
            F.count("*").alias("n_pairs"),
        )
        .withColumn(
            "consistent",
            (F.col("pairs_pos") == F.col("n_pairs")) | (F.col("pairs_neg") == F.col("n_pairs")),
        )
    )
