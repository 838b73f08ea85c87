"""Mutation class, spectrum, rate, sharing and phasing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bases as fb
from ..functions import calls as fc
from ..functions import ids
from ..operators import phasing as ph
from ..operators import sets as st
from ..operators import spectrum as sp
from ..plans.spine import CLASSES8, SBS96, TRINUC32
from .core import query, rounded

X = ["c_11", "c_12"]
OUT = ["SP1_family1_S1_offspring", "SP4_family2_S3_offspring"]
OUT_SQL = "('SP1_family1_S1_offspring', 'SP4_family2_S3_offspring')"

PYR = "(CASE WHEN ref IN ('C','T') THEN n_before || nuc_ref || nuc_after ELSE reverse(translate(n_before || nuc_ref || nuc_after, 'ACGT', 'TGCA')) END)"
SUB = "(CASE WHEN ref IN ('C','T') THEN ref || '>' || alt ELSE translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') END)"


def cls(sub: str, ctx: str) -> str:
    return f"(CASE WHEN {sub} = 'C>T' THEN CASE WHEN substr({ctx}, 3, 1) = 'G' THEN 'C>T_CpG' ELSE 'C>T_nonCpG' END ELSE {sub} END)"


# labelled germline rows, de-duplicated autosomal germline rows, labelled somatic rows
LAB = f"""lab AS (SELECT *, {PYR} AS ctx, {SUB} AS sub, {cls(SUB, PYR)} AS mc,
            substr({PYR},1,1) || '[' || {SUB} || ']' || substr({PYR},3,1) AS cat FROM dnm),
    ded AS (SELECT DISTINCT species, chrom, pos, ref, alt, father, mother, ctx, sub, mc, cat FROM lab
            WHERE chrom NOT IN ('c_11','c_12') AND child NOT IN {OUT_SQL}),
    som AS (SELECT *, oriented_ref || '>' || oriented_alt AS sub,
              {cls("(oriented_ref || '>' || oriented_alt)", "oriented_context")} AS mc,
              substr(oriented_context,1,1) || '[' || oriented_ref || '>' || oriented_alt || ']' || substr(oriented_context,3,1) AS cat
            FROM somatic WHERE substr(oriented_context,2,1) = oriented_ref AND oriented_alt <> oriented_ref)"""
C8 = ", ".join(f"('{c}')" for c in CLASSES8)
SP7 = "(SELECT DISTINCT species FROM dnm)"
GCOUNT = f"""gc AS (SELECT s.species, c.mc, count(d.mc) AS n FROM {SP7} s CROSS JOIN (VALUES {C8}) c(mc)
             LEFT JOIN ded d ON d.species = s.species AND (d.mc = c.mc OR c.mc = 'overall') GROUP BY 1, 2)"""
SCOUNT = f"""sc AS (SELECT s.species, c.mc, count(d.mc) AS n FROM {SP7} s CROSS JOIN (VALUES {C8}) c(mc)
             LEFT JOIN som d ON d.species = s.species AND (d.mc = c.mc OR c.mc = 'overall') GROUP BY 1, 2)"""


def den(src: str, name: str, mult: int, where: str = "true") -> str:
    pick = """CASE c.mc WHEN 'overall' THEN true WHEN 'C>T_CpG' THEN trinuc LIKE '_CG'
              WHEN 'C>T_nonCpG' THEN trinuc LIKE '_C_' AND trinuc NOT LIKE '_CG'
              ELSE substr(trinuc, 2, 1) = substr(c.mc, 1, 1) END"""
    return f"""{name} AS (SELECT species, c.mc, CAST(coalesce(sum(n) FILTER (WHERE {pick}), 0) AS BIGINT) * {mult} AS d
               FROM {src} CROSS JOIN (VALUES {C8}) c(mc) WHERE {where} GROUP BY 1, 2)"""


NOT_X = "chrom NOT IN ('c_11','c_12')"
BASE = f"WITH {LAB}, {GCOUNT}, {SCOUNT}, {den('trinuc', 'gd', 1, NOT_X)}, {den('trinuc', 'sd', 11)}"


def germline(t):
    rows = t.dnm.filter(~F.col("chrom").isin(*X) & ~F.col("child").isin(*OUT))
    return sp.dedup_dnm(sp.labelled_germline(rows), sp.DNM_KEY)


def germline_table(t):
    denoms = sp.class_denominators(t.trinuc.filter(~F.col("chrom").isin(*X)), ["species"])
    return sp.class_counts(germline(t), ["species"]).join(denoms, ["species", "mutation_class"])


def somatic_table(t):
    denoms = sp.class_denominators(t.trinuc, ["species"]).withColumn("denom", F.col("denom") * 11)
    return sp.class_counts(sp.labelled_somatic(t.somatic), ["species"]).join(
        denoms, ["species", "mutation_class"]
    )


@query(
    "agg28_dedup_dnm",
    """SELECT chrom, pos, ref, alt, father, mother, min(child) AS child FROM dnm
       GROUP BY chrom, pos, ref, alt, father, mother""",
)
def _(t):
    cols = [*sp.DNM_KEY, "child"]
    return sp.dedup_dnm(t.dnm.select(*cols), sp.DNM_KEY, ["child"])


@query("agg29_class_counts", BASE + " SELECT species, mc AS mutation_class, n AS n_mutations FROM gc")
def _(t):
    return sp.class_counts(germline(t), ["species"])


@query(
    "agg29_somatic_counts",
    BASE + " SELECT species, mc AS mutation_class, n AS n_mutations FROM sc",
)
def _(t):
    return sp.class_counts(sp.labelled_somatic(t.somatic), ["species"])


@query(
    "agg29_drop_counts",
    f"""WITH {LAB}, k AS (SELECT child FROM callable_bp WHERE child NOT IN {OUT_SQL}),
        r AS (SELECT *, CASE WHEN chrom IN ('c_11','c_12') THEN 'x' WHEN child NOT IN (SELECT child FROM k) THEN 'offspring' ELSE 'used' END AS rule FROM lab)
        SELECT species, count(*) AS n_total_rows, count(*) FILTER (WHERE rule = 'x') AS n_dropped_x,
          count(*) FILTER (WHERE rule = 'offspring') AS n_dropped_offspring, CAST(0 AS BIGINT) AS n_skipped_unclassified,
          count(DISTINCT (chrom, pos, ref, alt, father, mother)) FILTER (WHERE rule = 'used') AS n_unique FROM r GROUP BY species""",
)
def _(t):
    kept = t.callable_bp.filter(~F.col("child").isin(*OUT))
    return sp.germline_drop_counts(t.dnm, kept, X, ["species"])


@query("agg30_class_denominators", BASE + " SELECT species, mc AS mutation_class, d AS denom FROM gd")
def _(t):
    return sp.class_denominators(t.trinuc.filter(~F.col("chrom").isin(*X)), ["species"])


@query(
    "agg31_rates",
    BASE
    + """ SELECT gc.species, gc.mc AS mutation_class, n AS n_mutations, d AS denom, round(n / (2.0 * d), 15) AS rate
          FROM gc JOIN gd ON gd.species = gc.species AND gd.mc = gc.mc""",
)
def _(t):
    denoms = sp.class_denominators(t.trinuc.filter(~F.col("chrom").isin(*X)), ["species"])
    out = sp.rates(
        sp.class_counts(germline(t), ["species"]), denoms, ["species", "mutation_class"], 2, limits=False
    )
    return rounded(out, 15)


# quantile of the gamma distribution by bisection on its series
BISECT = """b AS (
      SELECT key_, CAST(a AS DOUBLE) AS a, target, CAST(0 AS DOUBLE) AS lo, a + 12 * sqrt(a) + 40.0 AS hi, 0 AS i FROM want WHERE a > 0
      UNION ALL
      SELECT key_, a, target, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, i + 1
      FROM (SELECT *, list_sum([exp(-mid + (a + k) * ln(mid) - lgamma(a + k + 1)) for k in range(0, 3000)]) < target AS below
            FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 55) m) r)"""


@query(
    "tst01_poisson_ci",
    BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", want AS (SELECT species || mc || 'l' AS key_, n AS a, 0.025 AS target FROM gc
                    UNION ALL SELECT species || mc || 'h', n + 1, 0.975 FROM gc),
          {BISECT}, q AS (SELECT key_, (lo + hi) / 2 AS x FROM b WHERE i = 55)
        SELECT gc.species, gc.mc AS mutation_class, n AS n_mutations, round(coalesce(l.x, 0), 6) AS ci_low, round(h.x, 6) AS ci_high
        FROM gc LEFT JOIN q l ON l.key_ = species || mc || 'l' LEFT JOIN q h ON h.key_ = species || mc || 'h'""",
)
def _(t):
    from ..functions.special import poisson_limits

    counts = sp.class_counts(germline(t), ["species"]).withColumn(
        "l", poisson_limits(F.col("n_mutations"))
    )
    return rounded(
        counts.select(
            "species", "mutation_class", "n_mutations", F.col("l.low").alias("ci_low"), F.col("l.high").alias("ci_high")
        ),
        6,
    )


CATS = ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(SBS96))


def spec(src: str) -> str:
    return f"""s96 AS (SELECT s.species, c.rank, c.category, count(d.cat) AS n FROM {SP7} s CROSS JOIN (VALUES {CATS}) c(rank, category)
               LEFT JOIN {src} d ON d.species = s.species AND d.cat = c.category GROUP BY 1, 2, 3)"""


S96 = """ SELECT species, rank, category, n, round(n / sum(n) OVER (PARTITION BY species), 9) AS fraction FROM s96"""


@query("agg32_spectrum96_germline", f"WITH {LAB}, {spec('ded')}" + S96)
def _(t):
    return rounded(sp.spectrum96(germline(t), ["species"]))


@query("agg32_spectrum96_somatic", f"WITH {LAB}, {spec('som')}" + S96)
def _(t):
    return rounded(sp.spectrum96(sp.labelled_somatic(t.somatic), ["species"]))


@query("agg32_spectrum96_unfiltered", f"WITH {LAB}, {spec('lab')}" + S96)
def _(t):
    return rounded(sp.spectrum96(sp.labelled_germline(t.dnm), ["species"]))


@query(
    "agg33_collapse7",
    f"WITH {LAB} SELECT species, mc AS mutation_class, count(*) AS n FROM som GROUP BY 1, 2",
)
def _(t):
    spectrum = sp.spectrum96(sp.labelled_somatic(t.somatic), ["species"])
    return sp.collapse7(spectrum, ["species"])


MASTER = BASE + """, both_ AS (SELECT gc.species, gc.mc, n, d, 'germline' AS level, 2 AS p FROM gc JOIN gd ON gd.species = gc.species AND gd.mc = gc.mc
      UNION ALL SELECT sc.species, sc.mc, n, d, 'somatic', 1 FROM sc JOIN sd ON sd.species = sc.species AND sd.mc = sc.mc),
    m AS (SELECT 'per_species' AS group_name, * FROM both_
      UNION ALL SELECT g.group_name, 'merged', mc, CAST(sum(n) AS BIGINT), CAST(sum(d) AS BIGINT), level, p FROM both_ JOIN group_members g ON g.species = both_.species
      GROUP BY g.group_name, mc, level, p)"""


@query(
    "agg34_rate_master",
    MASTER
    + """ SELECT group_name, species, level, mc AS mutation_class, n AS n_mutations, d AS denom, round(n / (1.0 * d * p), 15) AS rate FROM m""",
)
def _(t):
    return rounded(
        sp.rate_master(germline_table(t), somatic_table(t), t.group_members, limits=False), 15
    )


@query(
    "jn16_group_pool",
    MASTER
    + """ SELECT group_name, level, mc AS mutation_class, n AS n_mutations, d AS denom FROM m WHERE species = 'merged' AND level = 'somatic'""",
)
def _(t):
    table = somatic_table(t).withColumn("level", F.lit("somatic"))
    return sp.pool_groups(table, t.group_members, ["level", "mutation_class"], ["n_mutations", "denom"])


@query(
    "agg35_per_trio_long",
    f"""WITH {LAB},
       k AS (SELECT species, child, chrom, CAST(sum(bp) AS BIGINT) AS bp FROM callable_bp GROUP BY ALL),
       n AS (SELECT child, chrom, c.mc, count(*) AS n FROM lab JOIN (VALUES {C8}) c(mc) ON lab.mc = c.mc OR c.mc = 'overall' GROUP BY ALL),
       d AS (SELECT child, chrom, c.mc, CAST(coalesce(sum(n) FILTER (WHERE CASE c.mc WHEN 'overall' THEN true WHEN 'C>T_CpG' THEN trinuc LIKE '_CG'
              WHEN 'C>T_nonCpG' THEN trinuc LIKE '_C_' AND trinuc NOT LIKE '_CG' ELSE substr(trinuc, 2, 1) = substr(c.mc, 1, 1) END), 0) AS BIGINT) AS d
             FROM trinuc CROSS JOIN (VALUES {C8}) c(mc) WHERE {NOT_X} GROUP BY ALL)
       SELECT k.species, k.child, k.chrom, c.mc AS mutation_class, k.bp AS callable_bp, coalesce(n.n, 0) AS n_mutations,
              CASE WHEN k.chrom IN ('c_11','c_12') THEN 'x_chromosome' ELSE 'autosome' END AS chrom_group,
              CASE WHEN k.chrom IN ('c_11','c_12') THEN CASE WHEN c.mc = 'overall' THEN k.bp END ELSE d.d END AS denom_bp,
              CASE WHEN k.child IN {OUT_SQL} THEN 'no' ELSE 'yes' END AS included
       FROM k CROSS JOIN (VALUES {C8}) c(mc)
       LEFT JOIN n ON n.child = k.child AND n.chrom = k.chrom AND n.mc = c.mc
       LEFT JOIN d ON d.child = k.child AND d.chrom = k.chrom AND d.mc = c.mc""",
)
def _(t):
    return sp.per_trio_long(t.callable_bp, sp.labelled_germline(t.dnm), t.trinuc, X, OUT)


@query(
    "agg61_pooled_rate_rows",
    f"""WITH {LAB}, n AS (SELECT c.mc, count(*) AS n FROM lab JOIN (VALUES {C8}) c(mc) ON lab.mc = c.mc OR c.mc = 'overall'
          WHERE {NOT_X} AND child NOT IN {OUT_SQL} GROUP BY c.mc),
        {den('trinuc', 'gd', 2, NOT_X + ' AND child NOT IN ' + OUT_SQL)}
       SELECT n.mc AS mutation_class, n.n AS n_mutations, CAST(sum(gd.d) AS BIGINT) AS denom, round(n.n / sum(gd.d), 15) AS rate
       FROM n JOIN gd ON gd.mc = n.mc GROUP BY n.mc, n.n""",
)
def _(t):
    per_trio = sp.per_trio_long(t.callable_bp, sp.labelled_germline(t.dnm), t.trinuc, X, OUT)
    return rounded(sp.pooled_rate_rows(per_trio), 15)


FC = """ f AS (SELECT species, {k}, n_g, d_g, n_s, d_s, n_g / (1.0 * d_g) AS rg, n_s / (1.0 * d_s) AS rs FROM j)
    SELECT species, {k}, n_g, d_g, n_s, d_s, round(rg, 15) AS germline_rate, round(rs, 15) AS somatic_rate,
      CASE WHEN rg > 0 THEN round(rs / rg, 9) END AS fold_change,
      CASE WHEN rg > 0 AND rs > 0 THEN round(log2(rs / rg), 9) END AS log2_fc,
      CASE WHEN n_g > 0 AND n_s > 0 THEN round(exp(ln(rs / rg) - 1.96 * sqrt(1.0 / n_g + 1.0 / n_s)), 9) END AS fc_low,
      CASE WHEN n_g > 0 AND n_s > 0 THEN round(exp(ln(rs / rg) + 1.96 * sqrt(1.0 / n_g + 1.0 / n_s)), 9) END AS fc_high FROM f"""


def fc_rounded(df):
    small = ("germline_rate", "somatic_rate")
    return df.select(
        *[
            F.round(c, 15 if c in small else 9).alias(c) if ty == "double" else F.col(c)
            for c, ty in df.dtypes
        ]
    )


@query(
    "agg36_fold_change",
    BASE
    + """, j AS (SELECT gc.species, gc.mc AS mutation_class, gc.n AS n_g, gd.d * 2 AS d_g, sc.n AS n_s, sd.d AS d_s
          FROM gc JOIN gd ON gd.species = gc.species AND gd.mc = gc.mc JOIN sc ON sc.species = gc.species AND sc.mc = gc.mc
          JOIN sd ON sd.species = gc.species AND sd.mc = gc.mc),"""
    + FC.format(k="mutation_class"),
)
def _(t):
    return fc_rounded(
        sp.fold_change(germline_table(t), somatic_table(t), ["species", "mutation_class"])
    )


def table96(labelled, trinuc, mult):
    spectrum = sp.spectrum96(labelled, ["species"]).select(
        "species", "category", F.col("n").alias("n_mutations"), sp.context_of().alias("trinuc")
    )
    denom = trinuc.groupBy("species", "trinuc").agg((F.sum("n") * mult).alias("denom"))
    return spectrum.join(denom, ["species", "trinuc"], "left").fillna(0, subset=["denom"])


@query(
    "agg36_fold_change_96",
    f"""WITH {LAB}, g AS (SELECT * FROM (WITH {spec('ded')} SELECT * FROM s96)), s AS (SELECT * FROM (WITH {spec('som')} SELECT * FROM s96)),
      gt AS (SELECT species, trinuc, CAST(sum(n) AS BIGINT) AS n FROM trinuc WHERE {NOT_X} GROUP BY 1, 2),
      st AS (SELECT species, trinuc, CAST(sum(n) AS BIGINT) * 11 AS n FROM trinuc GROUP BY 1, 2),
      j0 AS (SELECT g.species, g.category, g.n AS n_g, coalesce(gt.n, 0) * 2 AS d_g, s.n AS n_s, coalesce(st.n, 0) AS d_s
        FROM g JOIN s ON s.species = g.species AND s.category = g.category
        LEFT JOIN gt ON gt.species = g.species AND gt.trinuc = substr(g.category,1,1) || substr(g.category,3,1) || substr(g.category,7,1)
        LEFT JOIN st ON st.species = g.species AND st.trinuc = substr(g.category,1,1) || substr(g.category,3,1) || substr(g.category,7,1)),
      f AS (SELECT *, n_g / nullif(1.0 * d_g, 0) AS rg, n_s / nullif(1.0 * d_s, 0) AS rs FROM j0)
      SELECT species, category, n_g, d_g, n_s, d_s, round(rg, 15) AS germline_rate, round(rs, 15) AS somatic_rate,
        CASE WHEN rg > 0 THEN round(rs / rg, 9) END AS fold_change,
        CASE WHEN rg > 0 AND rs > 0 THEN round(log2(rs / rg), 9) END AS log2_fc,
        CASE WHEN n_g > 0 AND n_s > 0 AND rg > 0 THEN round(exp(ln(rs / rg) - 1.96 * sqrt(1.0 / n_g + 1.0 / n_s)), 9) END AS fc_low,
        CASE WHEN n_g > 0 AND n_s > 0 AND rg > 0 THEN round(exp(ln(rs / rg) + 1.96 * sqrt(1.0 / n_g + 1.0 / n_s)), 9) END AS fc_high FROM f""",
)
def _(t):
    g = table96(germline(t), t.trinuc.filter(~F.col("chrom").isin(*X)), 1)
    s = table96(sp.labelled_somatic(t.somatic), t.trinuc, 11)
    return fc_rounded(sp.fold_change(g, s, ["species", "category"]))


@query(
    "agg34_rate_master_96",
    f"""WITH {LAB}, g AS (SELECT * FROM (WITH {spec('ded')} SELECT * FROM s96)), s AS (SELECT * FROM (WITH {spec('som')} SELECT * FROM s96)),
      gt AS (SELECT species, trinuc, CAST(sum(n) AS BIGINT) AS d FROM trinuc WHERE {NOT_X} GROUP BY 1, 2),
      st AS (SELECT species, trinuc, CAST(sum(n) AS BIGINT) * 11 AS d FROM trinuc GROUP BY 1, 2),
      b AS (SELECT g.species, category, n, coalesce(d, 0) AS d, 'germline' AS level, 2 AS p FROM g LEFT JOIN gt ON gt.species = g.species AND trinuc = substr(category,1,1) || substr(category,3,1) || substr(category,7,1)
            UNION ALL SELECT s.species, category, n, coalesce(d, 0), 'somatic', 1 FROM s LEFT JOIN st ON st.species = s.species AND trinuc = substr(category,1,1) || substr(category,3,1) || substr(category,7,1)),
      m AS (SELECT 'per_species' AS group_name, * FROM b UNION ALL SELECT group_name, 'merged', category, CAST(sum(n) AS BIGINT), CAST(sum(d) AS BIGINT), level, p
            FROM b JOIN group_members q ON q.species = b.species GROUP BY group_name, category, level, p)
      SELECT group_name, species, level, category, n AS n_mutations, d AS denom, CASE WHEN d > 0 THEN round(n / (1.0 * d * p), 15) END AS rate FROM m""",
)
def _(t):
    g = table96(germline(t), t.trinuc.filter(~F.col("chrom").isin(*X)), 1)
    s = table96(sp.labelled_somatic(t.somatic), t.trinuc, 11)
    return rounded(sp.rate_master(g, s, t.group_members, "category", limits=False), 15)


# --- sharing and phasing -----------------------------------------------------------------

LOCI = """loc AS (SELECT species, family, chrom, pos, ref, alt, count(DISTINCT child) AS nc,
    CASE WHEN bool_or(phased = 'P') AND bool_or(phased = 'M') THEN 'CONFLICT' WHEN bool_or(phased = 'P') THEN 'P'
         WHEN bool_or(phased = 'M') THEN 'M' WHEN bool_or(phased = 'U') THEN 'U' ELSE 'F' END AS phase
    FROM {src} GROUP BY ALL)"""


@query(
    "agg37_sharing_summary",
    "WITH inc AS (SELECT * FROM dnm WHERE phased <> 'F' AND child NOT IN "
    + OUT_SQL
    + "), "
    + LOCI.format(src="inc")
    + f"""SELECT a.species, n_rows_included, n_rows_excluded, n_families, n_offspring, n_unique, n_shared, n_loci FROM
         (SELECT species, count(*) FILTER (WHERE phased <> 'F' AND child NOT IN {OUT_SQL}) AS n_rows_included,
                 count(*) FILTER (WHERE phased = 'F' OR child IN {OUT_SQL}) AS n_rows_excluded FROM dnm GROUP BY species) a
         JOIN (SELECT species, count(DISTINCT family) AS n_families, count(DISTINCT child) AS n_offspring FROM inc GROUP BY species) b ON b.species = a.species
         JOIN (SELECT species, count(*) FILTER (WHERE nc = 1) AS n_unique, count(*) FILTER (WHERE nc >= 2) AS n_shared, count(*) AS n_loci
               FROM loc GROUP BY species) c ON c.species = a.species""",
)
def _(t):
    return ph.sharing_summary(t.dnm, t.species_dim, OUT)


@query(
    "agg37_sharing_by_class",
    "WITH inc AS (SELECT * FROM dnm WHERE phased <> 'F'), " + LOCI.format(src="inc")
    + """ SELECT sociality, count(*) FILTER (WHERE nc >= 2) AS n_shared, count(*) FILTER (WHERE nc = 1) AS n_unique,
            round(count(*) FILTER (WHERE nc >= 2) / count(*), 9) AS shared_fraction
          FROM loc JOIN species_dim d ON d.species = loc.species GROUP BY sociality""",
)
def _(t):
    return rounded(ph.sharing_by_class(ph.loci(t.dnm, drop_f=True), t.species_dim))


@query("agg38_resolve_phase", "WITH " + LOCI.format(src="dnm") + " SELECT family, chrom, pos, ref, alt, phase FROM loc")
def _(t):
    return ph.loci(t.dnm).select("family", "chrom", "pos", "ref", "alt", "phase")


@query(
    "agg39_phase_breakdown",
    "WITH "
    + LOCI.format(src="dnm")
    + """, n AS (SELECT coalesce(species, 'OVERALL') AS species, CASE WHEN nc >= 2 THEN 'shared' ELSE 'unique' END AS sharing,
           count(*) FILTER (WHERE phase = 'P') AS "n_P", count(*) FILTER (WHERE phase = 'M') AS "n_M", count(*) FILTER (WHERE phase = 'U') AS "n_U",
           count(*) FILTER (WHERE phase = 'F') AS "n_F", count(*) FILTER (WHERE phase = 'CONFLICT') AS "n_CONFLICT", count(*) AS n_total
         FROM loc GROUP BY GROUPING SETS ((species, CASE WHEN nc >= 2 THEN 'shared' ELSE 'unique' END), (CASE WHEN nc >= 2 THEN 'shared' ELSE 'unique' END)))
       SELECT *, CASE WHEN "n_M" > 0 THEN round("n_P" / "n_M", 9) END AS bias, true AS sums_match FROM n""",
)
def _(t):
    return rounded(ph.phase_breakdown(ph.loci(t.dnm)))


PAR = (
    "WITH inc AS (SELECT * FROM dnm WHERE phased <> 'F'), "
    + LOCI.format(src="inc")
    + """, fam AS (SELECT species, family, count(*) FILTER (WHERE phase = 'P') AS p, count(*) FILTER (WHERE phase = 'M') AS m,
              count(*) FILTER (WHERE phase = 'U') AS u FROM loc GROUP BY 1, 2),
          sh AS (SELECT species, sum(p) / (sum(p) + sum(m)) AS s FROM fam GROUP BY species),
          z AS (SELECT fam.*, CASE WHEN p + m > 0 THEN p / (p + m) ELSE s END AS f FROM fam JOIN sh ON sh.species = fam.species),
          bp AS (SELECT species, CAST(sum(bp) AS BIGINT) AS callable_bp FROM callable_bp GROUP BY species)"""
)


@query(
    "agg40_parental_rates",
    PAR
    + """ SELECT z.species, CAST(sum(p) AS BIGINT) AS n_p, CAST(sum(m) AS BIGINT) AS n_m, CAST(sum(u) AS BIGINT) AS n_u,
            round(sum(p + u * f), 9) AS paternal, round(sum(m + u * (1 - f)), 9) AS maternal, callable_bp,
            round(sum(p + u * f) / (2 * callable_bp), 9) AS paternal_rate, round(sum(m + u * (1 - f)) / (2 * callable_bp), 9) AS maternal_rate
          FROM z JOIN bp ON bp.species = z.species GROUP BY z.species, callable_bp""",
)
def _(t):
    return rounded(ph.parental_rates(ph.loci(t.dnm, drop_f=True), t.callable_bp))


def units(unit: str) -> str:
    return f"""u AS (SELECT b.species, b.{unit}, b.callable_sites, coalesce(n.n, 0) AS unique_dnms,
          coalesce(n.n, 0) / (2.0 * b.callable_sites) AS rate
        FROM (SELECT species, {unit}, CAST(sum(bp) AS BIGINT) AS callable_sites FROM callable_bp GROUP BY species, {unit}) b
        LEFT JOIN (SELECT {unit}, count(DISTINCT (chrom, pos, ref, alt)) AS n FROM dnm GROUP BY {unit}) n ON n.{unit} = b.{unit})"""


MUT = ["chrom", "pos", "ref", "alt"]


@query(
    "agg41_family_rates",
    f"WITH {units('family')} SELECT species, family, callable_sites, unique_dnms, round(rate, 15) AS rate FROM u",
)
def _(t):
    return rounded(ph.unit_rates(t.dnm, t.callable_bp, ["species", "family"], MUT), 15)


@query(
    "agg41_individual_rates",
    f"WITH {units('child')} SELECT species, child, callable_sites, unique_dnms, round(rate, 15) AS rate FROM u",
)
def _(t):
    return rounded(ph.unit_rates(t.dnm, t.callable_bp, ["species", "child"], MUT), 15)


@query(
    "agg41_rate_dispersion",
    f"""WITH {units('child')} SELECT species, count(*) AS n_units, CAST(sum(unique_dnms) AS BIGINT) AS total_dnms,
          CAST(sum(callable_sites) AS BIGINT) AS total_callable, round(sum(unique_dnms) / (2 * sum(callable_sites)), 12) AS pooled_rate,
          round(var_pop(rate), 12) AS variance, round(stddev_pop(rate) / avg(rate), 12) AS cv FROM u GROUP BY species""",
)
def _(t):
    per = ph.unit_rates(t.dnm, t.callable_bp, ["species", "child"], MUT)
    return rounded(ph.rate_dispersion(per, ["species"]), 12)


@query(
    "win13_nunique_over",
    """SELECT child, chrom, pos, n_offspring, CASE WHEN n_offspring > 1 THEN 'shared' ELSE 'unique' END AS sharing
       FROM dnm JOIN (SELECT family, chrom, pos, ref, alt, count(DISTINCT child) AS n_offspring FROM dnm GROUP BY ALL) n
         USING (family, chrom, pos, ref, alt)""",
)
def _(t):
    return ph.with_sharing(t.dnm, ["family", *MUT]).select("child", "chrom", "pos", "n_offspring", "sharing")


# --- leave-one-out baseline, directions ------------------------------------------------------

LOO = f"""WITH {LAB}, k AS (SELECT som.species, sociality, mc, count(*) AS n FROM som JOIN species_dim d ON d.species = som.species GROUP BY ALL),
   l AS (SELECT k.*, CAST(coalesce((SELECT sum(n) FROM k x WHERE x.mc = k.mc AND x.sociality = 'subsocial' AND x.species <> k.species), 0) AS BIGINT) AS baseline FROM k),
   e AS (SELECT *, sum(n) OVER (PARTITION BY species) AS tn, sum(baseline) OVER (PARTITION BY species) AS tb FROM l),
   o AS (SELECT *, log2(((n + 0.5) * (tb - baseline + 0.5)) / ((tn - n + 0.5) * (baseline + 0.5))) AS effect FROM e)"""


def loo(t):
    spectrum = sp.collapse7(sp.spectrum96(sp.labelled_somatic(t.somatic), ["species"]), ["species"])
    table = spectrum.join(t.species_dim.select("species", "sociality"), "species")
    return sp.baseline_loo(table, ["mutation_class"], "n", F.col("sociality") == "subsocial")


def effects(t):
    rows = loo(t)
    totals = rows.groupBy("species").agg(F.sum("n").alias("tn"), F.sum("baseline").alias("tb"))
    return rows.join(totals, "species").withColumn(
        "effect",
        fc.log2_odds("n", F.col("tn") - F.col("n"), "baseline", F.col("tb") - F.col("baseline")),
    )


@query("agg58_baseline_loo", LOO + " SELECT species, sociality, mc AS mutation_class, n, baseline FROM l")
def _(t):
    return loo(t).select("species", "sociality", "mutation_class", "n", "baseline")


@query(
    "scl12_odds",
    LOO
    + """ SELECT species, mc AS mutation_class, round(effect, 9) AS log2_or,
          round((n + 1.0) * (tb - baseline + 1.0) / ((tn - n + 1.0) * (baseline + 1.0)), 9) AS plus_one_or,
          CASE WHEN (tn - n) * baseline <> 0 THEN round(CAST(n AS DOUBLE) * CAST(tb - baseline AS DOUBLE) / (CAST(tn - n AS DOUBLE) * CAST(baseline AS DOUBLE)), 9) END AS raw_or FROM o""",
)
def _(t):
    a, b, c, d = F.col("n"), F.col("tn") - F.col("n"), F.col("baseline"), F.col("tb") - F.col("baseline")
    return rounded(
        effects(t).select(
            "species",
            "mutation_class",
            F.col("effect").alias("log2_or"),
            fc.pseudocount_odds(a, b, c, d).alias("plus_one_or"),
            fc.raw_odds(a, b, c, d).alias("raw_or"),
        )
    )


@query(
    "agg57_direction_consistency",
    LOO
    + """, g AS (SELECT mc AS mutation_class, count(*) FILTER (WHERE abs(effect) > 0.02 AND effect > 0) AS n_up,
             count(*) FILTER (WHERE abs(effect) > 0.02 AND effect < 0) AS n_down, count(*) AS n_total FROM o WHERE sociality = 'social' GROUP BY mc)
          SELECT *, CASE WHEN n_up + n_down = n_total AND (n_up = 0 OR n_down = 0) THEN 'all'
                         WHEN n_up + n_down > 0 AND (n_up = 0 OR n_down = 0) THEN 'partial' ELSE 'mixed_or_none' END AS consistent FROM g""",
)
def _(t):
    tests = effects(t).filter("sociality = 'social'").withColumn("sig", F.abs("effect") > 0.02)
    return sp.direction_consistency(tests, ["mutation_class"], "effect", "sig")


@query(
    "agg57_sign_agreement",
    LOO
    + """ SELECT mc AS mutation_class, count(*) FILTER (WHERE effect > 0) AS pairs_pos, count(*) FILTER (WHERE effect < 0) AS pairs_neg,
            count(*) AS n_pairs, bool_and(effect > 0) OR bool_and(effect < 0) AS consistent FROM o GROUP BY mc""",
)
def _(t):
    return sp.sign_agreement(effects(t), ["mutation_class"], "effect")


# --- joins, spines, scalars, sorts -------------------------------------------------------------


def often_false(t):
    """Offspring with more than one false-positive label in nine."""
    n_f = F.count_if(F.col("phased") == "F")
    return t.dnm.groupBy("child").agg((9 * n_f > F.count("*")).alias("bad")).filter("bad").select("child")


@query(
    "jn14_keep_offspring",
    f"""SELECT child, count(*) AS n FROM dnm WHERE child IN (SELECT child FROM callable_bp)
          AND child NOT IN (SELECT child FROM dnm GROUP BY child HAVING 9 * count(*) FILTER (WHERE phased = 'F') > count(*))
        GROUP BY child""",
)
def _(t):
    kept = sp.keep_offspring(t.dnm, t.callable_bp, often_false(t))
    return kept.groupBy("child").agg(F.count("*").alias("n"))


T32 = ", ".join(f"('{x}')" for x in TRINUC32)


@query(
    "jn15_context_spine",
    f"""SELECT k.child, c.trinuc, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT child FROM trinuc) k
        CROSS JOIN (VALUES {T32}) c(trinuc) LEFT JOIN trinuc t ON t.child = k.child AND t.trinuc = c.trinuc GROUP BY 1, 2""",
)
def _(t):
    return sp.context_spine(t.trinuc, ["child"])


@query(
    "jn07_fill_left",
    """SELECT k.child, k.chrom, count(d.pos) AS n FROM (SELECT DISTINCT child, chrom FROM callable_bp) k
       LEFT JOIN (SELECT * FROM dnm WHERE phased = 'M') d ON d.child = k.child AND d.chrom = k.chrom GROUP BY 1, 2""",
)
def _(t):
    from ..plans.spine import fill_left

    n = t.dnm.filter("phased = 'M'").groupBy("child", "chrom").agg(F.count("*").alias("n"))
    return fill_left(t.callable_bp.select("child", "chrom").distinct(), n, ["child", "chrom"], ["n"])


@query(
    "flt23_somatic_valid",
    """SELECT species, count(*) AS n_total, count(*) FILTER (WHERE substr(oriented_context,2,1) <> oriented_ref
         OR oriented_alt = oriented_ref) AS n_skipped FROM somatic GROUP BY species""",
)
def _(t):
    return sp.drop_counts(t.somatic, ["species"])


@query("scl02_sbs96", f"WITH {LAB} SELECT chrom, pos, child, cat AS category FROM lab")
def _(t):
    return t.dnm.select(
        "chrom", "pos", "child", fb.sbs96("ref", "alt", "n_before", "nuc_after").alias("category")
    )


@query("scl03_sbs_class7", f"WITH {LAB} SELECT chrom, pos, child, mc AS mutation_class FROM lab")
def _(t):
    ctx = F.concat("n_before", "nuc_ref", "nuc_after")
    return t.dnm.select("chrom", "pos", "child", fb.sbs_class7("ref", "alt", ctx).alias("mutation_class"))


@query(
    "scl04_mut_type_flags",
    f"""WITH {LAB}, f AS (SELECT *, sub = 'C>T' AND (substr(ctx,1,1) = 'G' OR substr(ctx,3,1) = 'G') AS cpg,
             sub = 'C>T' AND (substr(ctx,1,1) IN ('C','T') OR substr(ctx,3,1) IN ('C','T')) AS cpd FROM lab)
        SELECT chrom, pos, child, sub || CASE WHEN cpg THEN ',CpG>TpG' ELSE '' END || CASE WHEN cpd THEN ',C>T_CPD' ELSE '' END AS mut_type,
               cpg AS if_cpg, cpd AS if_cpd FROM f""",
)
def _(t):
    label, cpg, cpd = fb.mutation_labels("n_before", "ref", "nuc_after", "alt")
    return t.dnm.select(
        "chrom", "pos", "child", label.alias("mut_type"), cpg.alias("if_cpg"), cpd.alias("if_cpd")
    )


@query(
    "scl06_id_parsers",
    r"""SELECT DISTINCT child, regexp_extract(child, '^([A-Z0-9]+)_', 1) AS species,
          regexp_extract(child, '^([A-Z0-9]+_family[0-9]+)_', 1) AS family_label, regexp_replace(child, '_S[0-9]+_offspring$', '') AS family_key,
          split_part(child, '_', 2) AS family, 'offspring' AS role FROM dnm""",
)
def _(t):
    return t.dnm.select("child").distinct().select(
        "child",
        ids.child_species("child").alias("species"),
        ids.child_family_label("child").alias("family_label"),
        ids.family_key("child").alias("family_key"),
        ids.sample_family("child").alias("family"),
        ids.trio_role("child").alias("role"),
    )


@query(
    "scl08_sociality",
    """SELECT species, CASE WHEN species IN ('SP0','SP1','SP2') THEN 'Social' ELSE 'Subsocial' END AS sociality, count(*) AS n
       FROM dnm GROUP BY species""",
)
def _(t):
    return t.dnm.groupBy("species").agg(F.count("*").alias("n")).select(
        "species", ids.sociality("species", ["SP0", "SP1", "SP2"]).alias("sociality"), "n"
    )


@query(
    "src12_species_dims",
    """SELECT d.species, d.sociality, d.leaf_order, count(*) AS n_rows FROM dnm JOIN species_dim d ON d.species = dnm.species GROUP BY ALL""",
)
def _(t):
    from ..plans.lookup import lookup_join

    return (
        lookup_join(t.dnm.select("species"), t.species_dim, ["species"])
        .groupBy("species", "sociality", "leaf_order")
        .agg(F.count("*").alias("n_rows"))
    )


@query(
    "src08_callable_summary",
    """SELECT chrom, bp, CASE WHEN ends_with(ind_chrom, '_' || chrom) THEN left(ind_chrom, length(ind_chrom) - length(chrom) - 1) END AS individual
       FROM callable_bp""",
)
def _(t):
    return t.callable_bp.select(
        "chrom", "bp", ids.strip_suffix("ind_chrom", F.concat(F.lit("_"), "chrom")).alias("individual")
    )


@query(
    "srt02_family_order",
    """SELECT child, row_number() OVER (ORDER BY split_part(child, '_', 1), CAST(regexp_extract(child, 'family([0-9]+)', 1) AS INT),
         CAST(regexp_extract(child, '_S([0-9]+)', 1) AS INT)) AS place FROM (SELECT DISTINCT child FROM dnm) z""",
)
def _(t):
    return ph.with_family_place(t.dnm.select("child").distinct(), "child")


@query(
    "srt05_leaf_order",
    "WITH " + LOCI.format(src="dnm")
    + """ SELECT d.species, d.leaf_order, s.sharing, count(loc.phase) FILTER (WHERE phase = 'P') AS "n_P", count(loc.phase) FILTER (WHERE phase = 'M') AS "n_M",
            count(loc.phase) FILTER (WHERE phase = 'U') AS "n_U", count(loc.phase) AS n_loci
          FROM species_dim d CROSS JOIN (VALUES ('unique'), ('shared')) s(sharing)
          LEFT JOIN loc ON loc.species = d.species AND CASE WHEN loc.nc >= 2 THEN 'shared' ELSE 'unique' END = s.sharing GROUP BY 1, 2, 3""",
)
def _(t):
    return ph.species_spine_counts(ph.loci(t.dnm), t.species_dim).orderBy("leaf_order", "sharing")


@query(
    "set01_union_all",
    """SELECT source, species, n FROM (SELECT 'germline' AS source, species, count(*) AS n FROM dnm GROUP BY species
       UNION ALL SELECT 'somatic', species, count(*) FROM somatic GROUP BY species) z""",
)
def _(t):
    return st.counts_by_source({"germline": t.dnm, "somatic": t.somatic}, ["species"])


@query(
    "set03_difference",
    "SELECT DISTINCT child FROM callable_bp WHERE child NOT IN "
    "(SELECT child FROM dnm GROUP BY child HAVING 9 * count(*) FILTER (WHERE phased = 'F') > count(*))",
)
def _(t):
    return st.keys_without(t.callable_bp, often_false(t), ["child"])


@query(
    "set04_intersection",
    """SELECT family, chrom, pos, list_has_any(list(DISTINCT child), [family || '_S1_offspring', family || '_S2_offspring']) AS sampled,
              count(DISTINCT child) AS n_children FROM dnm GROUP BY family, chrom, pos""",
)
def _(t):
    sample = F.array(*[F.concat(F.col("family"), F.lit(f"_S{i}_offspring")) for i in (1, 2)])
    found = st.members_overlap(t.dnm, ["family", "chrom", "pos"], "child", sample)
    return found.withColumnRenamed("n_members", "n_children")
