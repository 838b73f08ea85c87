"""Trio queries: callability, candidates, read support, pedigree checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls as fc
from ..functions import ids
from ..operators import sites as si
from ..operators import trios as tr
from ..plans import spans
from .core import query, rounded

WIDE = ["gt", "dp", "ref_dp", "alt_dp"]
GRID = [20, 22, 24, 25, 26, 28, 30]  # fixed values: depth floors


#: Order of the samples in ``site_calls``.
SAMPLES = [
    f"SP_family{k}_{role}" for k in range(1, 5)
    for role in ("F_female", "M_male", *[f"S{i}_offspring" for i in range(1, 6)])
]


def pedigree(t):
    return tr.trios_from_samples(t.samples)


def panel(t):
    return si.panel(SAMPLES, pedigree(t))


def passing_sites(t, samples):
    """PASS sites with the mean depths of the samples over all sites."""
    return si.with_means(tr.pass_only(t.site_calls), si.mean_depths(t.site_calls, samples))


def callable_trios(t, where=None):
    samples = panel(t)
    sites = passing_sites(t, samples)
    sites = sites if where is None else sites.filter(where)
    return si.callable_trio_sites(sites, samples, ["gt", "ref_dp", "alt_dp"], ["ref", "alt"])


def candidates(t):
    samples = panel(t)
    return si.callable_candidates(passing_sites(t, samples), samples, ["ref_dp", "alt_dp"], ["ref", "alt"])


def isolated(t):
    return spans.isolated_rows(candidates(t), ["child", "chrom"], "pos", 150)


def wide(t):
    return si.trio_rows(t.site_calls, panel(t), WIDE, site_fields=["alt"])


COLS = ["chrom", "pos", "child"]
X = ["c_11", "c_12"]


@query("flt01_trio_sites", "SELECT chrom, pos, family, child, c_gt FROM o_wide")
def _(t):
    return si.trio_sites(t.site_calls, panel(t)).select("chrom", "pos", "family", "child", "c_gt")


@query("flt02_pass_only", "SELECT chrom, pos, sample, gt FROM calls WHERE filter = 'PASS'")
def _(t):
    return tr.pass_only(t.calls).select("chrom", "pos", "sample", "gt")


@query(
    "flt03_hard_filter",
    """SELECT chrom, pos, CASE WHEN coalesce(qd < 2, false) OR coalesce(mq < 40, false)
         OR coalesce(fs > 60, false) OR coalesce(sor > 3, false) OR coalesce(mqranksum < -12.5, false)
         OR coalesce(readposranksum < -8, false) THEN 'gatk_germline' ELSE 'PASS' END AS filter
       FROM sites""",
)
def _(t):
    return tr.hard_filter(t.sites).select("chrom", "pos", "filter")


@query(
    "flt04_callable_sites",
    """SELECT c.chrom, c.pos, count(*) AS n_calls FROM calls c
       LEFT JOIN o_ok k ON k.chrom = c.chrom AND k.pos = c.pos AND k.sample = c.sample
       WHERE c.filter = 'PASS' GROUP BY c.chrom, c.pos HAVING count(k.sample) = count(*)""",
)
def _(t):
    return si.callable_sites(passing_sites(t, panel(t)), ["chrom", "pos"])


@query(
    "flt04_reference_quality",
    """WITH q AS (SELECT c.chrom, c.pos, c.dp >= 0.5 * d.mean_depth AND c.dp <= 2 * d.mean_depth AND c.dp >= 5
            AND CASE WHEN c.pos % 3 <> 0 THEN CASE WHEN c.gq % 10 <> 0 THEN c.gq ELSE 0 END ELSE c.dp * 7 % 100 END >= 20 AS ok
          FROM calls c JOIN mean_depth d ON d.sample = c.sample AND d.chrom = c.chrom WHERE c.filter = 'PASS')
       SELECT chrom, pos, count(*) AS n_calls FROM q GROUP BY chrom, pos HAVING bool_and(ok)""",
)
def _(t):
    """Sites with GQ among their fields (some values missing, which is 0) and sites with RGQ instead."""
    samples = panel(t)
    sites = passing_sites(t, samples).withColumns(
        {
            "has_gq": F.col("pos") % 3 != 0,
            "calls": F.transform(
                "calls",
                lambda x: F.when(
                    x.isNotNull(),
                    F.struct(
                        x["dp"].alias("dp"), F.when(x["gq"] % 10 != 0, x["gq"]).alias("gq"), (x["dp"] * 7 % 100).alias("rgq")
                    ),
                ),
            ),
        }
    )
    return si.callable_sites(sites, ["chrom", "pos"], min_q=20, min_dp=5, has_gq="has_gq")


@query("flt04_callable_trio_sites", "SELECT chrom, pos, child, f_dp, m_dp, c_dp FROM o_callable")
def _(t):
    return callable_trios(t).select(*COLS, "f_dp", "m_dp", "c_dp")


@query(
    "flt05_min_depth_grid",
    """SELECT child, chrom, g.min_dp, count(*) AS n_sites
       FROM o_callable JOIN (VALUES (20), (22), (24), (25), (26), (28), (30)) g(min_dp)
         ON least(f_dp, m_dp, c_dp) >= g.min_dp
       GROUP BY child, chrom, g.min_dp""",
)
def _(t):
    return (
        tr.min_depth_grid(callable_trios(t), GRID)
        .groupBy("child", "chrom", "min_dp")
        .agg(F.count("*").alias("n_sites"))
    )


@query(
    "flt06_ploidy_min_depth",
    """SELECT chrom, pos, child, sex_id FROM o_callable JOIN sex ON ind = child
       WHERE chrom IN ('c_11', 'c_12') AND m_dp >= 26 AND f_dp >= 13
         AND c_dp >= CASE WHEN sex_id = 'female' THEN 26 ELSE 13 END""",
)
def _(t):
    x = callable_trios(t, F.col("chrom").isin(X))
    return tr.ploidy_min_depth(x, t.sex, 26).select(*COLS, "sex_id")


@query(
    "flt07_biallelic_snps",
    "SELECT chrom, pos, ref, alt FROM sites WHERE length(ref) = 1 AND alt IN ('A', 'C', 'G', 'T')",
)
def _(t):
    return tr.biallelic_snps(t.sites).select("chrom", "pos", "ref", "alt")


CANDIDATE = "f_gt = '0/0' AND m_gt = '0/0' AND c_gt = '0/1'"


@query("flt08_de_novo_candidates", f"SELECT chrom, pos, child FROM o_callable WHERE {CANDIDATE}")
def _(t):
    return candidates(t).select(*COLS)


@query(
    "flt09_hemizygous_candidates",
    """SELECT chrom, pos, child FROM o_callable JOIN sex ON ind = child
       WHERE chrom IN ('c_11', 'c_12') AND f_gt = '0/0' AND m_gt = '0/0'
         AND c_gt = CASE WHEN sex_id = 'female' THEN '0/1' ELSE '1/1' END""",
)
def _(t):
    samples = panel(t)
    on_x = passing_sites(t, samples).filter(F.col("chrom").isin(X))
    return si.hemizygous_candidates(on_x, samples, t.sex, 0).select(*COLS)


BALANCED = """c_ref_dp + c_alt_dp > 0 AND CAST(c_alt_dp AS DOUBLE) / (c_ref_dp + c_alt_dp) >= 0.3
              AND CAST(c_alt_dp AS DOUBLE) / (c_ref_dp + c_alt_dp) <= 0.7"""
CROWDED = """EXISTS (SELECT 1 FROM cand x WHERE x.child = cand.child AND x.chrom = cand.chrom
             AND x.pos <> cand.pos AND abs(x.pos - cand.pos) <= 150)"""


@query(
    "flt10_allele_balance",
    f"""WITH cand AS (SELECT * FROM o_callable WHERE {CANDIDATE})
        SELECT chrom, pos, child, c_ref_dp, c_alt_dp FROM cand WHERE NOT {CROWDED} AND {BALANCED}""",
)
def _(t):
    return tr.allele_balance(isolated(t)).select(*COLS, "c_ref_dp", "c_alt_dp")


@query(
    "flt10_allele_balance_x",
    f"""SELECT chrom, pos, child, sex_id FROM o_callable JOIN sex ON ind = child
        WHERE chrom IN ('c_11', 'c_12') AND f_gt = '0/0' AND m_gt = '0/0'
          AND CASE WHEN sex_id = 'female' THEN c_gt = '0/1' AND {BALANCED} ELSE c_gt = '1/1' END""",
)
def _(t):
    """Daughters' candidates have to be balanced; sons have one X, and theirs are exempt."""
    samples = panel(t)
    on_x = passing_sites(t, samples).filter(F.col("chrom").isin(X))
    found = si.hemizygous_candidates(on_x, samples, t.sex, 0, ["ref_dp", "alt_dp"])
    return tr.allele_balance(found, exempt=F.col("sex_id") == "male").select(*COLS, "sex_id")


@query(
    "flt11_read_support",
    """SELECT chrom, pos, child FROM o_wide
       WHERE alt <> '.' AND c_ref_dp <> 0 AND f_alt_dp <= 0 AND m_alt_dp <= 0""",
)
def _(t):
    return tr.read_support_check(wide(t)).select(*COLS)


@query(
    "flt11_read_support_x",
    """SELECT chrom, pos, child FROM o_wide JOIN sex ON ind = child
       WHERE alt <> '.' AND CASE WHEN sex_id = 'female' THEN c_ref_dp <> 0 ELSE c_ref_dp = 0 END
         AND f_alt_dp <= 0 AND m_alt_dp <= 0""",
)
def _(t):
    x = tr.ploidy_min_depth(wide(t), t.sex, 0)
    return tr.read_support_check(x, sex="sex_id").select(*COLS)


@query(
    "flt12_exclude",
    """SELECT chrom, pos, child, phased FROM dnm WHERE chrom NOT IN ('c_11', 'c_12')
         AND child <> 'SP1_family1_S1_offspring' AND family <> 'SP2_family2' AND phased <> 'F'""",
)
def _(t):
    return tr.exclude(
        t.dnm, X, ["SP1_family1_S1_offspring"], ["SP2_family2"], ["F"]
    ).select(*COLS, "phased")


@query(
    "flt12_drop_counts",
    """SELECT drop_rule, count(*) AS n FROM (
         SELECT CASE WHEN chrom IN ('c_11', 'c_12') THEN 'chrom'
                     WHEN child = 'SP1_family1_S1_offspring' THEN 'trio'
                     WHEN family = 'SP2_family2' THEN 'family'
                     WHEN phased = 'F' THEN 'phase' ELSE 'kept' END AS drop_rule FROM dnm) z
       GROUP BY drop_rule""",
)
def _(t):
    ruled = tr.with_drop_rule(
        t.dnm, X, ["SP1_family1_S1_offspring"], ["SP2_family2"], ["F"]
    )
    return ruled.groupBy(F.coalesce("drop_rule", F.lit("kept")).alias("drop_rule")).agg(
        F.count("*").alias("n")
    )


@query(
    "flt13_chromosome_kind",
    r"""SELECT contig, regexp_matches(contig, '^[^_]*_[0-9]+$') AS autosome,
               regexp_matches(contig, '(^|_)[XYZWxyzw][^_]*$') AS sex_contig, count(*) AS n
        FROM (SELECT CASE WHEN chrom = 'c_11' THEN 'c_X1' WHEN chrom = 'c_12' THEN 'c_x_Y2' ELSE chrom END AS contig
              FROM sites) z GROUP BY 1, 2, 3""",
)
def _(t):
    contig = (
        F.when(F.col("chrom") == "c_11", "c_X1")
        .when(F.col("chrom") == "c_12", "c_x_Y2")
        .otherwise(F.col("chrom"))
    )
    return (
        t.sites.select(contig.alias("contig"))
        .groupBy("contig")
        .agg(F.count("*").alias("n"))
        .select(
            "contig",
            ids.is_autosome("contig").alias("autosome"),
            ids.is_sex_contig("contig").alias("sex_contig"),
            "n",
        )
    )


@query("flt14_maf_filter", "SELECT chrom, pos, af FROM sites WHERE least(af, 1 - af) > 0.1")
def _(t):
    return tr.maf_filter(t.sites, 0.1).select("chrom", "pos", "af")


@query(
    "flt15_mask_genotypes",
    """SELECT chrom, pos, sample, CASE WHEN coalesce(gq < 60, false) OR coalesce(dp < 20, false)
         THEN NULL ELSE gt END AS gt FROM calls""",
)
def _(t):
    return tr.mask_genotypes(t.calls, 60, 20).select("chrom", "pos", "sample", "gt")


@query(
    "flt16_call_rate",
    """SELECT chrom, pos, count(*) FILTER (WHERE NOT (gq < 60 OR dp < 20)) AS n_called, count(*) AS n_total
       FROM calls GROUP BY chrom, pos
       HAVING count(*) FILTER (WHERE NOT (gq < 60 OR dp < 20)) >= 0.5 * count(*)""",
)
def _(t):
    return tr.call_rate_sites(tr.mask_genotypes(t.calls, 60, 20), 0.5)


@query(
    "flt17_depth_window_snps",
    """SELECT chrom, pos, dp, qual FROM sites WHERE alt IN ('A', 'C', 'G', 'T') AND qual >= 20
       AND dp BETWEEN 15 AND 60""",
)
def _(t):
    return tr.depth_window_snps(t.sites, 15, 60).select("chrom", "pos", "dp", "qual")


@query(
    "flt18_filter_alignments",
    "SELECT read_name, chrom, pos FROM reads WHERE mapq >= 60 AND flags & 2 = 2 AND flags & 4 = 0",
)
def _(t):
    return tr.filter_alignments(t.reads).select("read_name", "chrom", "pos")


@query(
    "jn01_mean_depth_join",
    """SELECT c.chrom, c.pos, c.sample, CASE WHEN c.dp >= 0.5 * d.mean_depth AND c.dp <= 2 * d.mean_depth
         AND c.gq >= 60 THEN true ELSE false END AS call_ok
       FROM calls c LEFT JOIN mean_depth d ON d.sample = c.sample AND d.chrom = c.chrom""",
)
def _(t):
    return tr.with_call_ok(t.calls, t.mean_depth).select("chrom", "pos", "sample", "call_ok")


@query(
    "jn02_proximity_anti",
    f"""WITH cand AS (SELECT chrom, chrom AS child, pos, gt FROM calls)
        SELECT chrom, pos, gt FROM cand WHERE NOT EXISTS (
          SELECT 1 FROM (SELECT DISTINCT chrom, pos FROM cand) x WHERE x.chrom = cand.chrom
            AND x.pos <> cand.pos AND x.pos BETWEEN cand.pos - 12 AND cand.pos + 12)""",
)
def _(t):
    return spans.isolated_rows(t.calls, ["chrom"], "pos", 12).select("chrom", "pos", "gt")


@query(
    "jn05_flank_windows",
    f"""SELECT chrom, pos, child, pos - 150 AS region_start, pos + 150 AS region_end
        FROM o_callable WHERE {CANDIDATE}""",
)
def _(t):
    return tr.flank_windows(candidates(t), 150).select(*COLS, "region_start", "region_end")


@query("jn10_trios", "SELECT family, mother, father, child FROM trios")
def _(t):
    return tr.trios_from_samples(t.calls)


@query(
    "jn10_incomplete_families",
    """SELECT split_part(id1, '_', 2) AS family,
              count(DISTINCT CASE WHEN upper(substr(split_part(id1, '_', 3), 1, 1)) = 'F' THEN id1 END) AS n_mother,
              count(DISTINCT CASE WHEN upper(substr(split_part(id1, '_', 3), 1, 1)) = 'M' THEN id1 END) AS n_father,
              count(DISTINCT CASE WHEN upper(substr(split_part(id1, '_', 3), 1, 1)) = 'S' THEN id1 END) AS n_offspring
       FROM kin_pairs GROUP BY 1 HAVING n_mother = 0 OR n_father = 0 OR n_offspring = 0""",
)
def _(t):
    return tr.incomplete_families(t.kin_pairs, "id1")


@query(
    "snk03_dnm_sheet",
    f"SELECT chrom, pos, ref, alt, child, father, mother FROM o_callable WHERE {CANDIDATE}",
)
def _(t):
    return tr.dnm_sheet(candidates(t))


@query(
    "agg01_site_counts",
    "SELECT child, chrom, count(*) AS n_sites FROM o_callable GROUP BY child, chrom",
)
def _(t):
    return callable_trios(t).groupBy("child", "chrom").agg(F.count("*").alias("n_sites"))


@query(
    "agg10_genotype_classes",
    """SELECT sample, chrom, count(*) FILTER (WHERE gt = '0/0') AS hom_ref,
              count(*) FILTER (WHERE gt = '0/1') AS het, count(*) FILTER (WHERE gt = '1/1') AS hom_alt
       FROM calls GROUP BY sample, chrom""",
)
def _(t):
    return tr.genotype_classes(t.calls, ["sample", "chrom"])


@query(
    "agg11_het_allele_depths",
    "SELECT sample, chrom, pos, ref_dp, alt_dp FROM calls WHERE gt = '0/1'",
)
def _(t):
    return tr.het_allele_depths(t.calls)


@query(
    "agg48_mendel_consistency",
    """WITH w AS (SELECT * FROM (
          SELECT t.family, t.mother, t.father, t.child, c.gt AS c_gt, f.gt AS f_gt, m.gt AS m_gt
          FROM trios t
          JOIN (SELECT * FROM calls WHERE gq >= 50 AND dp >= 5) c ON c.sample = t.child
          JOIN (SELECT * FROM calls WHERE gq >= 50 AND dp >= 5) f
            ON f.sample = t.father AND f.chrom = c.chrom AND f.pos = c.pos
          JOIN (SELECT * FROM calls WHERE gq >= 50 AND dp >= 5) m
            ON m.sample = t.mother AND m.chrom = c.chrom AND m.pos = c.pos) z
          WHERE (f_gt = '0/0' AND m_gt = '1/1') OR (f_gt = '1/1' AND m_gt = '0/0')),
        n AS (SELECT t.family, t.mother, t.father, t.child, count(w.child) AS n_informative,
                count(*) FILTER (WHERE w.c_gt = '0/1') AS n_het,
                count(*) FILTER (WHERE w.c_gt = '0/0') AS n_homref,
                count(*) FILTER (WHERE w.c_gt = '1/1') AS n_homalt
              FROM trios t LEFT JOIN w ON w.family = t.family AND w.child = t.child GROUP BY ALL)
       SELECT *, CASE WHEN n_informative >= 10 THEN round(n_het / n_informative, 9) END AS consistency,
              CASE WHEN n_informative >= 10 THEN round((n_homref + n_homalt) / n_informative, 9) END AS error_rate,
              CASE WHEN n_informative < 10 THEN 'insufficient-sites'
                   WHEN n_het / n_informative >= 0.5 THEN 'consistent' ELSE 'INCONSISTENT' END AS verdict
       FROM n""",
)
def _(t):
    return rounded(
        si.mendel_consistency(t.site_calls, panel(t), pedigree(t), 50, 5, consistency_min=0.5, min_sites=10)
    )


FLAGSHIP = f"""
    WITH cand AS (SELECT * FROM o_callable WHERE {CANDIDATE}),
    den AS (SELECT child, count(*) AS callable_sites FROM o_callable GROUP BY child),
    num AS (SELECT child, count(*) AS n_dnm FROM cand WHERE NOT {CROWDED} AND {BALANCED} GROUP BY child)
    SELECT den.child, callable_sites, coalesce(n_dnm, 0) AS n_dnm,
           round(coalesce(n_dnm, 0) / (2.0 * callable_sites), 12) AS rate
    FROM den LEFT JOIN num ON num.child = den.child"""


@query("flagship_trio_rates", FLAGSHIP)
def trio_rates(t):
    """De novo candidates per trio and callable base, in one pass over the callable rows.

    The callable rows are folded to windows once; both counts come from those.
    """
    return rounded(tr.trio_rates(tr.callable_windows(callable_trios(t))), 12)
