"""Trio filters over the long call table: callability, de novo candidates, read support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls as fc
from ..functions import ids
from ..plans.cut import cut_lineage
from ..plans.lookup import lookup_join
from ..plans.spans import isolated_rows

SITE = ["chrom", "pos"]


# --- pedigree ------------------------------------------------------------------------


def trios_from_samples(samples: DataFrame, sample: str = "sample") -> DataFrame:
    """(family, mother, father, child) for families with both parents and an offspring.

    One grouping by family; the offspring list is as long as the family has members.
    """
    role, name = ids.trio_role(sample), F.col(sample)
    families = samples.groupBy(ids.sample_family(sample).alias("family")).agg(
        F.max(F.when(role == "F", name)).alias("mother"),
        F.max(F.when(role == "M", name)).alias("father"),
        F.collect_set(F.when(role == "offspring", name)).alias("children"),
    )
    return families.filter("mother IS NOT NULL AND father IS NOT NULL").select(
        "family", "mother", "father", F.explode("children").alias("child")
    )


def incomplete_families(samples: DataFrame, sample: str = "sample") -> DataFrame:
    """Families that cannot form a trio, with what is missing."""
    role = ids.trio_role(sample)
    return (
        samples.select(sample)
        .distinct()
        .groupBy(ids.sample_family(sample).alias("family"))
        .agg(
            F.count_if(role == "F").alias("n_mother"),
            F.count_if(role == "M").alias("n_father"),
            F.count_if(role == "offspring").alias("n_offspring"),
        )
        .filter("n_mother = 0 OR n_father = 0 OR n_offspring = 0")
    )


def trio_members(trios: DataFrame) -> DataFrame:
    """(family, sample, role) once per person and family; a parent may serve two families."""
    return trios.select(
        "family",
        F.explode(
            F.array(
                F.struct(F.col("mother").alias("sample"), F.lit("F").alias("member")),
                F.struct(F.col("father").alias("sample"), F.lit("M").alias("member")),
                F.struct(F.col("child").alias("sample"), F.lit("C").alias("member")),
            )
        ).alias("m"),
    ).select("family", "m.sample", "m.member").distinct()


def trio_wide(
    calls: DataFrame,
    trios: DataFrame,
    fields: list[str],
    site: list[str] | None = None,
    site_fields: list[str] | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """One row per (site, trio) with f_*, m_* and c_* columns; missing members drop the trio.

    One shuffle on (site, family): a group is the members of one family at one site, so its
    size is bounded by the pedigree and not by the data.  ``keep`` is a condition on one call
    and its role (``member``: M father, F mother, C child); it is applied before that shuffle,
    so a call that fails is never moved.  The rest is moved as it is and grouped afterwards,
    without partial lists.  Of repeated rows of a parent at a site the smallest is taken.
    """
    site = site or SITE
    site_fields = site_fields or []
    members = trio_members(trios).withColumnRenamed("family", "__family")
    base = calls.drop("family") if "family" in calls.columns else calls
    joined = lookup_join(base, members, ["sample"])
    if keep is not None:
        joined = joined.filter(keep)
    grouped = (
        joined.repartition(*site, "__family")
        .groupBy(*site, F.col("__family").alias("family"))
        .agg(F.collect_list(F.struct("member", "sample", *fields, *site_fields)).alias("__l"))
    )

    def those(member: str) -> Column:
        return F.filter("__l", lambda x: x["member"] == member)

    return (
        grouped.withColumn("f", F.array_min(those("M")))
        .withColumn("m", F.array_min(those("F")))
        .filter("m IS NOT NULL AND f IS NOT NULL")
        .select(*site, "family", "m", "f", F.explode(those("C")).alias("c"))
        .select(
            *site,
            "family",
            *[F.col(f"c.{x}").alias(x) for x in site_fields],
            F.col("f.sample").alias("father"),
            F.col("m.sample").alias("mother"),
            F.col("c.sample").alias("child"),
            *[F.col(f"{w}.{x}").alias(f"{w}_{x}") for w in "fmc" for x in fields],
        )
    )


def trio_sites(
    calls: DataFrame, trios: DataFrame, max_alleles: int = 2, alt: str = "alt", gt: str = "gt"
) -> DataFrame:
    """Trio sites with at most ``max_alleles`` alleles and no missing genotype.

    ``alt`` is comma-separated text or an array.
    """
    n_alt = (
        F.size(alt)
        if dict(calls.dtypes)[alt].startswith("array")
        else F.size(F.split(alt, ","))
    )
    called = F.col(gt).isNotNull() & ~F.col(gt).contains(".")
    few = calls.filter((n_alt + 1 <= max_alleles) & called)
    return trio_wide(few, trios, [gt])


# --- site and call predicates -----------------------------------------------------------


def pass_only(df: DataFrame, column: str = "filter", allow_empty: bool = False) -> DataFrame:
    ok = F.col(column) == "PASS"
    if allow_empty:
        ok = ok | F.col(column).isNull() | F.col(column).isin("", ".")
    return df.filter(ok)


def hard_filter(df: DataFrame, label: str = "gatk_germline", out: str = "filter") -> DataFrame:
    """Label sites that break a quality bound; a missing annotation does not fire."""
    # Site quality bounds.
    bad = (
        F.coalesce(F.col("qd") < 2.0, F.lit(False))
        | F.coalesce(F.col("mq") < 40.0, F.lit(False))
        | F.coalesce(F.col("fs") > 60.0, F.lit(False))
        | F.coalesce(F.col("sor") > 3.0, F.lit(False))
        | F.coalesce(F.col("mqranksum") < -12.5, F.lit(False))
        | F.coalesce(F.col("readposranksum") < -8.0, F.lit(False))
    )
    return df.withColumn(out, F.when(bad, F.lit(label)).otherwise(F.lit("PASS")))


def with_call_ok(
    calls: DataFrame,
    mean_depth: DataFrame,
    lo: float = 0.5,
    hi: float = 2.0,
    min_q: int = 60,
    gq: str = "gq",
    rgq: str | None = None,
    has_gq: str | None = None,
) -> DataFrame:
    """Add ``call_ok``: depth within [lo, hi] times the sample's mean on the chromosome and
    quality (GQ, else RGQ, else 0) at least ``min_q``.  No mean depth fails the call.

    The means are stored and measured once and broadcast within the bounds of ``lookup_join``,
    so the calls stay where they are; beyond the bounds the calls are salted."""
    quality = fc.site_quality(gq, rgq, has_gq) if rgq else F.coalesce(F.col(gq), F.lit(0))
    dp = F.coalesce(F.col("dp"), F.lit(0))
    mean = F.col("mean_depth")
    ok = (dp >= mean * lo) & (dp <= mean * hi) & (quality >= min_q)
    return (
        lookup_join(calls, cut_lineage(mean_depth.select("sample", "chrom", "mean_depth")), ["sample", "chrom"], "left")
        .withColumn("dp", dp)
        .withColumn("call_ok", F.coalesce(ok, F.lit(False)))
        .drop("mean_depth")
    )


def callable_sites(
    calls_ok: DataFrame, by: list[str], n_samples: Column | int | None = None
) -> DataFrame:
    """Sites where every call passes.  ``n_samples`` also fails sites with an absent row."""
    site = calls_ok.groupBy(*by).agg(
        F.bool_and("call_ok").alias("__ok"), F.count("*").alias("n_calls")
    )
    keep = F.col("__ok")
    if n_samples is not None:
        keep = keep & (F.col("n_calls") == n_samples)
    return site.filter(keep).drop("__ok")


def callable_trio_sites(
    calls_ok: DataFrame, trios: DataFrame, fields: list[str] | None = None,
    site_fields: list[str] | None = None,
) -> DataFrame:
    """(site, trio) rows where mother, father and child are present and pass.

    Failing calls go before the shuffle: a trio without one of its members is dropped anyway.
    """
    return trio_wide(calls_ok.filter("call_ok"), trios, ["dp", *(fields or [])], site_fields=site_fields)


def callable_candidates(
    calls_ok: DataFrame, trios: DataFrame, fields: list[str] | None = None,
    site_fields: list[str] | None = None, ref: str = "ref", alt: str = "alt",
) -> DataFrame:
    """De novo candidates at single-base sites, as ``de_novo_candidates(biallelic_snps(...))`` of
    ``callable_trio_sites`` gives them, with every condition applied before the shuffle.

    ``ref`` and ``alt`` describe the site: all its calls carry the same values.
    """
    fields = ["dp", "gt", *[x for x in fields or [] if x != "gt"]]
    expected = F.col("gt") == F.when(F.col("member") == "C", "0/1").otherwise("0/0")
    snps = biallelic_snps(calls_ok.filter("call_ok"), ref, alt)
    return trio_wide(snps, trios, fields, site_fields=site_fields, keep=expected)


def min_depth_grid(callable_trios: DataFrame, grid: list[int]) -> DataFrame:
    """Callable rows repeated for each depth floor they reach: one pass for the whole grid."""
    lowest = F.least("f_dp", "m_dp", "c_dp")
    return callable_trios.withColumn("min_dp", F.explode(F.array(*[F.lit(g) for g in grid]))).filter(
        lowest >= F.col("min_dp")
    )


def ploidy_min_depth(
    callable_trios: DataFrame, sex: DataFrame, min_dp: int, child: str = "child"
) -> DataFrame:
    """X-chromosome floor: full for the mother, half for the father, by sex for the child."""
    with_sex = lookup_join(
        callable_trios,
        sex.select(F.col("ind").alias(child), "sex_id"),
        [child],
    )
    scale = F.when(F.col("sex_id") == "female", 1.0).otherwise(0.5)
    return with_sex.filter(
        (F.col("m_dp") >= min_dp)
        & (F.col("f_dp") >= 0.5 * min_dp)
        & (F.col("c_dp") >= scale * min_dp)
    )


def biallelic_snps(df: DataFrame, ref: str = "ref", alt: str = "alt") -> DataFrame:
    """Single-base reference and exactly one single-base alternative, both in ACGT."""
    if dict(df.dtypes)[alt].startswith("array"):
        one = (F.size(alt) == 1) & F.get(F.col(alt), F.lit(0)).rlike("^[ACGT]$")
    else:
        one = F.col(alt).rlike("^[ACGT]$")
    return df.filter(F.col(ref).rlike("^[ACGT]$") & one)


def de_novo_candidates(wide: DataFrame) -> DataFrame:
    """Both parents 0/0 and the child 0/1."""
    return wide.filter("f_gt = '0/0' AND m_gt = '0/0' AND c_gt = '0/1'")


def callable_windows(callable_trios: DataFrame, width: int = 65536) -> DataFrame:
    """Callable rows folded to (child, chromosome, window): their number and the candidates.

    Numerator and denominator of a rate then come from one pass over the sites.  A window
    lists at most ``width`` candidates, and de novo candidates are rare.
    """
    snp = F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$")
    de_novo = (F.col("f_gt") == "0/0") & (F.col("m_gt") == "0/0") & (F.col("c_gt") == "0/1")
    site = F.struct("pos", "ref", "alt", "c_ref_dp", "c_alt_dp")
    window = F.floor(F.col("pos") / F.lit(width)).cast("bigint").alias("window")
    return callable_trios.groupBy("child", "chrom", window).agg(
        F.count("*").alias("n_callable"), F.collect_list(F.when(snp & de_novo, site)).alias("candidates")
    )


def trio_rates(windows: DataFrame, distance: int = 150, lo: float = 0.3, hi: float = 0.7) -> DataFrame:
    """De novo candidates per trio and callable base, from ``callable_windows``.

    The distance filter runs before allele balance, so an unbalanced candidate still removes
    its neighbour.
    """
    windows = cut_lineage(windows)
    den = windows.groupBy("child").agg(F.sum("n_callable").alias("callable_sites"))
    sites = windows.select("child", "chrom", F.explode("candidates").alias("s")).select("child", "chrom", "s.*")
    kept = allele_balance(isolated_rows(sites, ["child", "chrom"], "pos", distance), lo, hi)
    num = kept.groupBy("child").agg(F.count("*").alias("n_dnm"))
    return (
        den.join(num, "child", "left")
        .fillna(0, subset=["n_dnm"])
        .withColumn("rate", F.col("n_dnm") / (2.0 * F.col("callable_sites")))
    )


def hemizygous_candidates(wide_with_sex: DataFrame) -> DataFrame:
    """X chromosome: both parents 0/0; daughters 0/1, sons 1/1."""
    return wide_with_sex.filter(
        "f_gt = '0/0' AND m_gt = '0/0' AND "
        "((sex_id = 'female' AND c_gt = '0/1') OR (sex_id = 'male' AND c_gt = '1/1'))"
    )


def allele_balance(
    df: DataFrame,
    lo: float = 0.3,
    hi: float = 0.7,
    ref: str = "c_ref_dp",
    alt: str = "c_alt_dp",
    exempt: Column | None = None,
) -> DataFrame:
    """Keep lo <= alt/(ref+alt) <= hi; no reads drops the row; ``exempt`` rows pass."""
    total = F.col(ref) + F.col(alt)
    ratio = F.when(total > 0, F.col(alt) / total)
    ok = ratio.between(lo, hi)
    return df.filter(ok | exempt if exempt is not None else ok)


def read_support_check(df: DataFrame, sex: str | None = None, alt: str = "alt") -> DataFrame:
    """No alternate reads in the parents and reference reads in the child.

    With ``sex`` a son must have no reference reads instead.  ``alt`` = '.' is dropped.
    """
    child_ok = F.col("c_ref_dp") != 0
    if sex:
        child_ok = (
            F.when(F.col(sex) == "female", F.col("c_ref_dp") != 0)
            .when(F.col(sex) == "male", F.col("c_ref_dp") <= 0)
            .otherwise(F.lit(True))
        )
    return df.filter(
        (F.col(alt) != ".") & child_ok & (F.col("f_alt_dp") <= 0) & (F.col("m_alt_dp") <= 0)
    )


def two_allele_depths(df: DataFrame, ad: str) -> DataFrame:
    """Rows whose allele-depth array has exactly two entries."""
    return df.filter(F.size(ad) == 2)


def exclude(
    df: DataFrame,
    chroms: list[str] = (),
    trios: list[str] = (),
    families: list[str] = (),
    phases: list[str] = (),
    chrom: str = "chrom",
    child: str = "child",
    family: str = "family",
    phase: str = "phased",
) -> DataFrame:
    """Drop chromosomes, trios, families and phase labels."""
    ruled = with_drop_rule(df, chroms, trios, families, phases, chrom, child, family, phase)
    return ruled.filter("drop_rule IS NULL").drop("drop_rule")


def with_drop_rule(
    df, chroms=(), trios=(), families=(), phases=(),
    chrom="chrom", child="child", family="family", phase="phased",
) -> DataFrame:
    """First exclusion rule that applies to a row, or NULL; count it to audit the drops."""
    rule = F.lit(None).cast("string")
    for column, values, label in reversed(
        [(chrom, chroms, "chrom"), (child, trios, "trio"), (family, families, "family"), (phase, phases, "phase")]
    ):
        if values:
            rule = F.when(F.col(column).isin(*values), F.lit(label)).otherwise(rule)
    return df.withColumn("drop_rule", rule)


def maf_filter(df: DataFrame, threshold: float, af: str = "af") -> DataFrame:
    """min(AF, 1-AF) > threshold; a negative threshold keeps everything."""
    if threshold < 0:
        return df
    first = F.get(F.col(af), F.lit(0)) if dict(df.dtypes)[af].startswith("array") else F.col(af)
    return df.filter(F.least(first, 1.0 - first) > threshold)


def mask_genotypes(df: DataFrame, min_gq: float, min_dp: float) -> DataFrame:
    """Set genotypes below a floor to NULL; a missing GQ or DP does not mask."""
    low = F.coalesce(F.col("gq") < min_gq, F.lit(False)) | F.coalesce(
        F.col("dp") < min_dp, F.lit(False)
    )
    return df.withColumn("gt", F.when(~low, F.col("gt")))


def call_rate_sites(calls: DataFrame, rate: float, n_samples: int | None = None) -> DataFrame:
    """Sites genotyped in at least ``rate`` of the samples (of the rows when n is not given)."""
    called = F.count_if(F.col("gt").isNotNull())
    total = F.lit(n_samples) if n_samples else F.count("*")
    return (
        calls.groupBy(*SITE)
        .agg(called.alias("n_called"), total.alias("n_total"))
        .filter(F.col("n_called") >= rate * F.col("n_total"))
    )


def depth_window_snps(df: DataFrame, lo: int, hi: int, qual: float = 20) -> DataFrame:
    return biallelic_snps(df).filter(
        (F.col("qual") >= qual) & F.col("dp").between(lo, hi)
    )


def filter_alignments(
    reads: DataFrame, min_mapq: int = 60, require: int = 0x2, exclude_flags: int = 0x4
) -> DataFrame:
    """Mapping quality floor, all ``require`` bits set, no ``exclude_flags`` bit set."""
    flags = F.col("flags")
    return reads.filter(
        (F.col("mapq") >= min_mapq)
        & (flags.bitwiseAND(F.lit(require)) == require)
        & (flags.bitwiseAND(F.lit(exclude_flags)) == 0)
    )


# --- counts and checks -----------------------------------------------------------------


def dnm_sheet(candidates: DataFrame) -> DataFrame:
    return candidates.select("chrom", "pos", "ref", "alt", "child", "father", "mother")


def flank_windows(df: DataFrame, distance: int = 150, pos: str = "pos") -> DataFrame:
    """Region rows pos-d .. pos+d (closed)."""
    return df.withColumn("region_start", F.col(pos) - distance).withColumn(
        "region_end", F.col(pos) + distance
    )


def genotype_classes(calls: DataFrame, by: list[str]) -> DataFrame:
    label = fc.genotype_class("gt")
    return calls.groupBy(*by).agg(
        *[F.count_if(label == k).alias(k) for k in ("hom_ref", "het", "hom_alt")]
    )


def het_allele_depths(calls: DataFrame) -> DataFrame:
    return calls.filter(fc.genotype_class("gt") == "het").select(
        "sample", *SITE, "ref_dp", "alt_dp"
    )


def mendel_consistency(
    calls: DataFrame,
    trios: DataFrame,
    min_gq: float = 20,
    min_dp: float = 26,
    consistency_min: float = 0.9,
    min_sites: int = 100,
) -> DataFrame:
    """Share of heterozygous offspring at sites where the parents are opposite homozygotes.

    Trios without an informative site are reported with zero counts.
    """
    masked = mask_genotypes(calls, min_gq, min_dp).filter("gt IS NOT NULL")
    state = fc.genotype_class("gt")
    wide = trio_wide(
        masked.select("sample", *SITE, state.alias("state")).filter("state IS NOT NULL"),
        trios,
        ["state"],
    )
    informative = wide.filter(
        "(f_state = 'hom_ref' AND m_state = 'hom_alt') OR (f_state = 'hom_alt' AND m_state = 'hom_ref')"
    )
    return mendel_report(informative, trios, consistency_min, min_sites)


def mendel_report(informative: DataFrame, trios: DataFrame, consistency_min: float, min_sites: int) -> DataFrame:
    """Counts and verdict of every trio from its informative sites (family, child, c_state)."""
    counts = informative.groupBy("family", "child").agg(
        F.count("*").alias("n_informative"),
        F.count_if(F.col("c_state") == "het").alias("n_het"),
        F.count_if(F.col("c_state") == "hom_ref").alias("n_homref"),
        F.count_if(F.col("c_state") == "hom_alt").alias("n_homalt"),
    )
    n = F.col("n_informative")
    enough = n >= min_sites
    full = trios.select("family", "mother", "father", "child").join(
        counts, ["family", "child"], "left"
    ).fillna(0, subset=["n_informative", "n_het", "n_homref", "n_homalt"])
    return (
        full.withColumn("consistency", F.when(enough & (n > 0), F.col("n_het") / n))
        .withColumn(
            "error_rate", F.when(enough & (n > 0), (F.col("n_homref") + F.col("n_homalt")) / n)
        )
        .withColumn(
            "verdict",
            F.when(~enough, "insufficient-sites")
            .when(F.col("consistency") >= consistency_min, "consistent")
            .otherwise("INCONSISTENT"),
        )
    )
