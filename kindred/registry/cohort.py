"""Lane, family, expression, hit, feature and kinship queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls as fc
from ..functions import ids
from ..operators import batch as bt
from ..operators import coverage as cov
from ..operators import expression as ex
from ..operators import kinship as kin
from .core import query, rounded

SOCIAL = ["AFRICA", "ASIA"]
ROLE = r"CASE WHEN regexp_matches(individual, '(S\d+|_\d+)$') THEN 'proband' ELSE 'parent' END"
FROLE = r"CASE WHEN regexp_matches(individual, '(S\d+|_\d+)$') THEN 'offspring' WHEN regexp_matches(individual, '(Fema|female|Female|F)$') THEN 'mother' ELSE 'father' END"
SOC = "CASE WHEN species IN ('AFRICA', 'ASIA') THEN 'Social' ELSE 'Subsocial' END"


@query(
    "agg20_lane_sizes",
    """SELECT species, family, individual, coalesce(round_id, 'TOTAL') AS round_id, coalesce(lane, 'TOTAL') AS lane,
              CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / 1073741824.0, 9) AS size_gb
       FROM lanes GROUP BY GROUPING SETS ((species, family, individual, round_id, lane), (species, family, individual))""",
)
def _(t):
    return rounded(bt.lane_sizes(t.lanes))


@query(
    "agg21_coverage_from_bytes",
    """SELECT species, family, individual, round_id, lane, CAST(sum(bytes) AS BIGINT) AS bytes,
              round(sum(bytes) / g.genome_size, 9) AS coverage
       FROM lanes JOIN (SELECT r_name AS species, (r_regionkey + 1) * 1000 AS genome_size FROM region) g USING (species)
       GROUP BY species, family, individual, round_id, lane, g.genome_size""",
)
def _(t):
    genome = t.region.select(
        F.col("r_name").alias("species"), ((F.col("r_regionkey") + 1) * 1000).alias("genome_size")
    )
    sized = bt.lane_sizes(t.lanes).filter("lane <> 'TOTAL'").drop("size_gb")
    return rounded(bt.coverage_from_bytes(sized, genome).drop("genome_size"))


def labelled(t):
    return bt.with_labels(t.lanes, SOCIAL)


OCC = f"""occ AS (SELECT round_id, count(DISTINCT individual) AS n_individuals, count(DISTINCT (species, family)) AS n_families,
    count(DISTINCT species) AS n_species, count(DISTINCT {ROLE}) AS n_roles, count(DISTINCT {SOC}) AS n_classes, max({ROLE}) AS any_role
    FROM lanes GROUP BY round_id)"""


@query(
    "agg22_batch_occupancy",
    f"WITH {OCC} SELECT round_id, n_individuals, n_families, n_species, n_roles, n_classes FROM occ",
)
def _(t):
    return bt.batch_occupancy(labelled(t)).drop("any_role")


@query(
    "agg22_occupancy_summary",
    f"""WITH {OCC} SELECT count(*) AS n_flowcells, count(*) FILTER (WHERE n_species = 1) AS single_species,
          count(*) FILTER (WHERE n_families = 1) AS single_family, count(*) FILTER (WHERE n_classes = 1) AS single_class,
          count(*) FILTER (WHERE n_individuals = 1) AS single_individual,
          count(*) FILTER (WHERE n_roles = 1 AND any_role = 'parent') AS parent_only,
          count(*) FILTER (WHERE n_roles = 1 AND any_role = 'proband') AS proband_only, count(*) FILTER (WHERE n_roles > 1) AS mixed_role,
          min(n_individuals) AS min_individuals, median(n_individuals) AS median_individuals,
          round(avg(n_individuals), 9) AS mean_individuals, max(n_individuals) AS max_individuals FROM occ""",
)
def _(t):
    return rounded(bt.occupancy_summary(bt.batch_occupancy(labelled(t))))


@query(
    "agg22_count_of_counts",
    f"WITH {OCC} SELECT n_individuals, count(*) AS n_flowcells FROM occ GROUP BY n_individuals",
)
def _(t):
    return bt.count_of_counts(bt.batch_occupancy(labelled(t)), "n_individuals")


@query(
    "agg22_spread",
    f"""WITH {OCC}, f AS (SELECT species, family, count(DISTINCT round_id) AS n FROM lanes GROUP BY 1, 2),
        v AS (SELECT 'n_individuals' AS measure, n_individuals AS v FROM occ UNION ALL SELECT 'n_families', n_families FROM occ
              UNION ALL SELECT 'flowcells_per_family', n FROM f)
        SELECT measure, min(v) AS min, median(v) AS median, round(avg(v), 9) AS mean, max(v) AS max FROM v GROUP BY measure""",
)
def _(t):
    rows = labelled(t)
    occupancy = bt.batch_occupancy(rows)
    parts = [bt.spread(occupancy, c) for c in ("n_individuals", "n_families")]
    parts.append(bt.spread(bt.flowcells_per_family(rows), "flowcells_per_family"))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "agg23_coassignment",
    f"""SELECT species, family, count(*) FILTER (WHERE r > 1) AS shared_flowcells, count(*) AS n_flowcells FROM (
          SELECT round_id, species, family, count(DISTINCT {ROLE}) AS r FROM lanes GROUP BY 1, 2, 3) z GROUP BY 1, 2""",
)
def _(t):
    return bt.coassignment(labelled(t))


@query(
    "agg24_individual_batch_table",
    f"""SELECT individual, min(species) AS species, string_agg(DISTINCT family, ';' ORDER BY family) AS family,
          string_agg(DISTINCT round_id, ';' ORDER BY round_id) AS flowcell_ids, count(DISTINCT round_id) AS n_flowcells,
          string_agg(DISTINCT lane, ';' ORDER BY lane) AS lanes, count(*) AS n_lane_records,
          round(sum(coverage), 2) AS total_coverage, {ROLE} AS role,
          CASE WHEN min(species) IN ('AFRICA', 'ASIA') THEN 'Social' ELSE 'Subsocial' END AS sociality
        FROM lanes GROUP BY individual""",
)
def _(t):
    totals = t.lanes.groupBy("individual").agg(F.sum("coverage").alias("coverage"))
    return bt.individual_batch_table(t.lanes, totals, SOCIAL)


@query(
    "srt03_batch_order",
    f"""SELECT individual, {ROLE} AS role, {SOC} AS sociality, species, family FROM (SELECT DISTINCT individual, species, family FROM lanes) z
        ORDER BY sociality, species, family, role DESC, individual""",
)
def _(t):
    rows = labelled(t).select("individual", "role", "sociality", "species", "family").distinct()
    return bt.batch_order(rows)


FAM = f"""slots AS (SELECT DISTINCT species, family, individual, {FROLE} AS role FROM lanes),
   fam AS (SELECT species, family, count(*) FILTER (WHERE role = 'father') AS n_father, count(*) FILTER (WHERE role = 'mother') AS n_mother,
             count(*) FILTER (WHERE role = 'offspring') AS n_offspring, count(*) AS n_sequenced FROM slots GROUP BY 1, 2),
   fs AS (SELECT *, greatest(0, 1 - n_father) AS missing_father, greatest(0, 1 - n_mother) AS missing_mother,
             greatest(0, 6 - n_offspring) AS missing_offspring,
             greatest(0, 1 - n_father) + greatest(0, 1 - n_mother) + greatest(0, 6 - n_offspring) AS n_missing,
             greatest(0, n_offspring - 6) AS n_surplus, CAST(8 AS BIGINT) AS expected_total FROM fam)"""


@query(
    "agg25_family_structure",
    f"WITH {FAM} SELECT *, CASE WHEN n_missing = 0 THEN 'yes' ELSE 'no' END AS complete FROM fs",
)
def _(t):
    return bt.family_structure(bt.family_slots(t.lanes))


@query(
    "agg25_species_structure",
    f"""WITH {FAM}, u AS (SELECT species, count(DISTINCT individual) FILTER (WHERE role = 'father') AS n_father_unique,
           count(DISTINCT individual) FILTER (WHERE role = 'mother') AS n_mother_unique,
           count(DISTINCT individual) FILTER (WHERE role = 'offspring') AS n_offspring_unique,
           count(DISTINCT individual) AS n_sequenced_unique FROM slots GROUP BY species)
        SELECT u.*, f.n_families, f.expected_total, f.n_missing, f.n_surplus FROM u JOIN (SELECT species, count(*) AS n_families,
           CAST(sum(expected_total) AS BIGINT) AS expected_total, CAST(sum(n_missing) AS BIGINT) AS n_missing,
           CAST(sum(n_surplus) AS BIGINT) AS n_surplus FROM fs GROUP BY species) f ON f.species = u.species""",
)
def _(t):
    slots = bt.family_slots(t.lanes)
    return bt.species_structure(slots, bt.family_structure(slots))


@query(
    "agg25_overall_structure",
    f"""WITH {FAM}, w AS (SELECT (SELECT count(DISTINCT species) FROM fs) AS n_species, (SELECT count(*) FROM fs) AS n_families,
          (SELECT CAST(sum(n_sequenced) AS BIGINT) FROM fs) AS n_family_slot_records, (SELECT CAST(sum(expected_total) AS BIGINT) FROM fs) AS expected_total_slots,
          (SELECT CAST(sum(n_missing) AS BIGINT) FROM fs) AS n_missing, (SELECT CAST(sum(missing_father + missing_mother) AS BIGINT) FROM fs) AS n_missing_parents,
          (SELECT CAST(sum(missing_offspring) AS BIGINT) FROM fs) AS n_missing_offspring, (SELECT CAST(sum(n_surplus) AS BIGINT) FROM fs) AS n_surplus_offspring,
          (SELECT count(DISTINCT individual) FROM slots) AS n_sequenced_unique_individuals,
          (SELECT count(DISTINCT individual) FROM slots WHERE role <> 'offspring') AS n_parents_unique,
          (SELECT count(DISTINCT individual) FROM slots WHERE role = 'offspring') AS n_offspring_unique,
          (SELECT count(*) FROM (SELECT individual FROM slots GROUP BY individual HAVING count(*) > 1) q) AS n_shared_parents)
        UNPIVOT w ON COLUMNS(*) INTO NAME metric VALUE value""".replace("UNPIVOT w", "SELECT metric, value FROM (UNPIVOT w")
    + ") z",
)
def _(t):
    slots = bt.family_slots(t.lanes)
    return bt.overall_structure(slots, bt.family_structure(slots))


LANES = [f"L0{i}" for i in range(1, 8)]


@query(
    "agg60_lane_coverage",
    "SELECT individual, round_id, lane, round(sum(coverage), 9) AS coverage FROM lanes GROUP BY individual, round_id, lane",
)
def _(t):
    return rounded(bt.lane_coverage(t.lanes))


@query(
    "agg60_lane_matrix",
    "SELECT individual, round_id, "
    + ", ".join(f"round(coalesce(sum(coverage) FILTER (WHERE lane = '{x}'), 0), 9) AS \"{x}\"" for x in LANES)
    + f", round(coalesce(sum(coverage) FILTER (WHERE lane NOT IN {tuple(LANES)!r}), 0), 9) AS others"
    + " FROM lanes GROUP BY individual, round_id",
)
def _(t):
    return rounded(bt.lane_matrix(t.lanes, LANES, ["individual", "round_id"]))


@query(
    "src11_run_lane",
    r"""SELECT lane, round_id, n, CASE WHEN n % 2 = 0 THEN round_id ELSE 'NA' END AS run, CASE WHEN n % 2 = 0 THEN lane ELSE 'NA' END AS parsed_lane
        FROM (SELECT round_id, lane, count(*) AS n FROM lanes GROUP BY 1, 2) z""",
)
def _(t):
    files = t.lanes.groupBy("round_id", "lane").agg(F.count("*").alias("n"))
    name = F.when(
        F.col("n") % 2 == 0, F.concat(F.lit("PE100_"), "round_id", F.lit("_"), "lane", F.lit("_read_1.fq.gz"))
    ).otherwise(F.concat("round_id", F.lit(".fq.gz")))
    run, lane = ids.run_and_lane(name)
    return files.select("lane", "round_id", "n", run.alias("run"), lane.alias("parsed_lane"))


@query(
    "scl07_read_names",
    r"""SELECT individual, species || '_' || family || '_' || CASE WHEN individual LIKE '%Fema' THEN 'F_female'
          WHEN individual LIKE '%Ma' THEN 'M_male' ELSE regexp_extract(individual, '_(S\d+)$', 1) || '_offspring' END AS sample_name,
          pair AS read_pair, count(*) AS n
        FROM lanes CROSS JOIN (VALUES ('1'), ('2')) p(pair) GROUP BY ALL""",
)
def _(t):
    paths = t.lanes.withColumn("pair", F.explode(F.array(F.lit("1"), F.lit("2")))).withColumn(
        "path", F.concat_ws("/", F.lit("/raw"), "family", "individual", F.concat("round_id", F.lit("_"), "pair", F.lit(".fq.gz")))
    )
    name, pair = ids.read_sample_name("path", "species")
    return paths.groupBy("individual", name.alias("sample_name"), pair.alias("read_pair")).agg(F.count("*").alias("n"))


# --- expression ---------------------------------------------------------------------------------

TPM = """r AS (SELECT *, CASE WHEN length > 0 THEN count / (length / 1000.0) END AS rpk FROM expr),
   tp AS (SELECT *, CASE WHEN length > 0 THEN rpk / (sum(rpk) OVER (PARTITION BY sample) / 1e6) ELSE 0 END AS tpm FROM r)"""


@query("agg42_tpm", f"WITH {TPM} SELECT gene, sample, round(tpm, 6) AS tpm FROM tp")
def _(t):
    return rounded(ex.tpm(t.expr).select("gene", "sample", "tpm"), 6)


@query(
    "agg42_expressed_counts",
    f"WITH {TPM} SELECT sample, count(*) FILTER (WHERE tpm > 1) AS n_expressed FROM tp GROUP BY sample",
)
def _(t):
    return ex.expressed_counts(ex.tpm(t.expr))


def fisher_greater(a: str, b: str, c: str, d: str) -> str:
    lc = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"
    n1, n2, m1 = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    lp = f"{lc.format(n=n1, k='x')} + {lc.format(n=n2, k=f'{m1} - x')} - {lc.format(n=f'({n1} + {n2})', k=m1)}"
    return f"list_sum([exp({lp}) for x in range({a}, least({n1}, {m1}) + 1)])"


@query(
    "agg43_set_enrichment",
    f"""WITH {TPM}, g AS (SELECT tp.*, gs.gene IS NOT NULL AS ins FROM tp LEFT JOIN gene_set gs ON gs.gene = tp.gene),
        k AS (SELECT sample, count(*) FILTER (WHERE ins AND tpm > 800) AS set_expressed, count(*) FILTER (WHERE ins) AS set_total,
                round(avg(tpm) FILTER (WHERE ins), 6) AS set_mean, count(*) FILTER (WHERE NOT ins AND tpm > 800) AS bg_expressed,
                count(*) FILTER (WHERE NOT ins) AS bg_total, round(avg(tpm) FILTER (WHERE NOT ins), 6) AS bg_mean,
                round(quantile_cont(tpm, 0.5) FILTER (WHERE ins), 6) AS set_median FROM g GROUP BY sample)
        SELECT *, round(set_expressed / set_total, 6) AS set_share, round(bg_expressed / bg_total, 6) AS bg_share,
               round((set_expressed / set_total) / (bg_expressed / bg_total), 6) AS fold,
               round({fisher_greater('set_expressed', '(set_total - set_expressed)', 'bg_expressed', '(bg_total - bg_expressed)')}, 6) AS p_greater FROM k""",
)
def _(t):
    return rounded(ex.set_enrichment(ex.tpm(t.expr), t.gene_set, 800.0), 6)


@query(
    "srt04_top_variable_genes",
    f"""WITH {TPM} SELECT gene, round(var_samp(log2(tpm + 1)), 6) AS variance FROM tp WHERE gene IN (SELECT gene FROM gene_set)
        GROUP BY gene HAVING max(tpm) > 1 AND count(*) > 1 ORDER BY var_samp(log2(tpm + 1)) DESC, gene LIMIT 100""",
)
def _(t):
    return rounded(ex.top_variable_genes(ex.tpm(t.expr), t.gene_set), 6)


HITS = """fh AS (SELECT *, (qend - qstart + 1) / qlen * 100 AS coverage FROM hits
   WHERE evalue <= 5e-5 AND pident >= 30 AND (qend - qstart + 1) / qlen * 100 >= 50)"""
QGENE = "CASE WHEN contains(split_part(qseqid, '|', 3), '_HUMAN') THEN replace(split_part(qseqid, '|', 3), '_HUMAN', '') ELSE qseqid END"


@query(
    "flt19_filter_hits",
    f"WITH {HITS} SELECT qseqid, sseqid, evalue, pident, round(coverage, 9) AS coverage FROM fh",
)
def _(t):
    out = ex.filter_hits(t.hits, 5e-5, 30, 50)
    return out.select("qseqid", "sseqid", "evalue", "pident", F.round("coverage", 9).alias("coverage"))


@query(
    "agg44_best_hit",
    f"""WITH {HITS} SELECT query_gene, regexp_replace(sseqid, '\\.t\\d+$', '') AS target_gene, bitscore, pident, round(coverage, 9) AS coverage, hit_count
        FROM (SELECT *, {QGENE} AS query_gene, count(*) OVER (PARTITION BY {QGENE}) AS hit_count,
                row_number() OVER (PARTITION BY {QGENE} ORDER BY bitscore DESC, hit_order, hit_line, sseqid) AS r FROM fh) z WHERE r = 1""",
)
def _(t):
    return rounded(ex.best_hit(ex.filter_hits(t.hits, 5e-5, 30, 50), ["hit_order", "hit_line", "sseqid"]))


@query(
    "scl14_gene_names",
    rf"""SELECT DISTINCT qseqid, {QGENE} AS protein_gene, regexp_replace(sseqid, '\.t\d+$', '') AS transcript_gene,
           split_part(qseqid, '|', 2) AS described FROM hits""",
)
def _(t):
    header = F.concat("qseqid", F.lit(" protein GN="), F.get(F.split("qseqid", r"\|"), F.lit(1)), F.lit(" PE=1"))
    return t.hits.select(
        "qseqid",
        ids.protein_gene("qseqid").alias("protein_gene"),
        ids.transcript_gene("sseqid").alias("transcript_gene"),
        ids.description_gene(header).alias("described"),
    ).distinct()


@query(
    "jn13_orthogroup_lookup",
    """WITH m AS (SELECT l_orderkey AS group_id, 'g' || CAST(l_partkey AS VARCHAR) AS member FROM lineitem GROUP BY 1, 2)
       SELECT DISTINCT q.gene, a.group_id, b.member FROM gene_set q JOIN m a ON a.member = q.gene JOIN m b ON b.group_id = a.group_id""",
)
def _(t):
    groups = (
        t.lineitem.select(F.col("l_orderkey").alias("group_id"), F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("m"))
        .groupBy("group_id")
        .agg(F.array_join(F.collect_set("m"), ", ").alias("members"))
    )
    return ex.orthogroup_lookup(t.gene_set, groups).select("gene", "group_id", "member")


# --- features -------------------------------------------------------------------------------------

FCOV = """md AS (SELECT sample, avg(dp) AS mean_depth FROM calls GROUP BY sample),
   fcov AS (SELECT c.sample, f.feature_id, f.feature_type, sum(c.dp) / (count(c.dp) * any_value(m.mean_depth)) AS mean_scaled_dp FROM calls c
     JOIN md m ON m.sample = c.sample JOIN features f ON f.chrom = c.chrom AND c.pos BETWEEN f.start AND f.stop
     WHERE c.dp IS NOT NULL GROUP BY 1, 2, 3)"""


def feature_cov(t):
    mean = t.calls.groupBy("sample").agg(F.avg("dp").alias("mean_depth"))
    return ex.feature_coverage(t.calls, t.features, mean)


@query(
    "agg45_feature_coverage",
    f"WITH {FCOV} SELECT sample, feature_id, feature_type, round(mean_scaled_dp, 9) AS mean_scaled_dp FROM fcov",
)
def _(t):
    return rounded(feature_cov(t))


@query(
    "agg46_unique_absence",
    f"""WITH {FCOV}, e AS (SELECT split_part(feature_id, '.t', 1) AS gene, feature_id,
          bool_or(feature_type = 'exon' AND sample = 'SP_family1_F_female' AND mean_scaled_dp < 0.9) AS absent,
          coalesce(bool_and(mean_scaled_dp >= 0.3) FILTER (WHERE feature_type = 'exon' AND sample <> 'SP_family1_F_female'), true) AS others
          FROM fcov GROUP BY 1, 2)
        SELECT gene, CAST(max(CASE WHEN absent AND others THEN 1 ELSE 0 END) AS INT) AS unique_absent FROM e GROUP BY gene""".replace("< 0.9", "< 0.3"),
)
def _(t):
    return ex.unique_absence(feature_cov(t), "SP_family1_F_female", 0.3)


BIAS = """b AS (SELECT 'path' || CAST(l_suppkey % 9 AS VARCHAR) AS pathway, l_discount * 40 - 2 AS log2fc, l_returnflag = 'A' AS is_sig,
   l_linenumber AS n_consistent, 4 AS n_species FROM lineitem)"""


def bias_table(t):
    return t.lineitem.select(
        F.concat(F.lit("path"), (F.col("l_suppkey") % 9).cast("string")).alias("pathway"),
        (F.col("l_discount") * 40 - 2).alias("log2fc"),
        (F.col("l_returnflag") == "A").alias("is_sig"),
        F.col("l_linenumber").alias("n_consistent"),
        F.lit(4).alias("n_species"),
    )


@query(
    "agg47_bias_counts_threshold",
    f"""WITH {BIAS}, d AS (SELECT *, CASE WHEN log2fc > 1.1 THEN 'positive' WHEN log2fc < -1.1 THEN 'negative' ELSE 'unbiased' END AS bias FROM b)
        SELECT pathway, bias, bias = 'unbiased' OR n_consistent = n_species AS consistent, count(*) AS n FROM d GROUP BY 1, 2, 3""",
)
def _(t):
    return ex.bias_counts(bias_table(t), threshold=1.1)


@query(
    "agg47_bias_counts_significance",
    f"""WITH {BIAS}, d AS (SELECT *, CASE WHEN is_sig AND log2fc > 0 THEN 'positive' WHEN is_sig AND log2fc < 0 THEN 'negative' ELSE 'unbiased' END AS bias FROM b)
        SELECT pathway, bias, bias = 'unbiased' OR n_consistent = n_species AS consistent, count(*) AS n FROM d GROUP BY 1, 2, 3""",
)
def _(t):
    return ex.bias_counts(bias_table(t), mode="significance")


BAM_SAMPLE = """concat('SP_family', CAST(pos % 4 + 1 AS STRING), '_', CASE sample WHEN 'ind1' THEN 'F_female' WHEN 'ind2' THEN 'M_male'
    ELSE concat('S', CAST(CAST(substr(sample, 4) AS INT) - 2 AS STRING), '_offspring') END)"""


@query(
    "jn08_report_join",
    f"""SELECT a.sample, a.chrom, round(a.m, 9) AS bam_mean, round(b.m, 9) AS vcf_mean FROM
       (SELECT {BAM_SAMPLE} AS sample, chrom, avg(depth) AS m FROM depth GROUP BY 1, 2) a
       JOIN (SELECT sample, chrom, avg(dp) AS m FROM calls GROUP BY 1, 2) b ON b.sample = a.sample AND b.chrom = a.chrom""",
)
def _(t):
    return rounded(cov.mean_depth_report(t.depth.withColumn("sample", F.expr(BAM_SAMPLE)), t.calls))


# --- kinship ----------------------------------------------------------------------------------------

KP = "kp AS (SELECT least(id1, id2) AS id1, greatest(id1, id2) AS id2, n_snp, kinship, ibs0, o_orderkey FROM kin_pairs)"


def two_sides(t):
    return t.kin_pairs.select("id1", "id2", "n_snp", "kinship", "ibs0"), t.kin_lines


JOINED = f"""{KP}, j AS (SELECT coalesce(l.id1, r.id1) AS id1, coalesce(l.id2, r.id2) AS id2, l.n_snp, l.kinship, l.ibs0, r.z0
    FROM kp l FULL JOIN (SELECT least(id1, id2) AS id1, greatest(id1, id2) AS id2, z0 FROM kin_lines) r
      ON r.id1 = l.id1 AND r.id2 = l.id2)"""


@query("jn09_join_pairs", f"WITH {JOINED} SELECT * FROM j")
def _(t):
    return kin.join_pairs(*two_sides(t))


@query("set02_pair_union", f"WITH {JOINED} SELECT DISTINCT id1, id2 FROM j")
def _(t):
    left, right = (kin.unordered(x).select("id1", "id2") for x in two_sides(t))
    return left.union(right).distinct()


LETTER = "upper(substr(split_part({x}, '_', 3), 1, 1))"
CLASSED = JOINED + f""", k AS (SELECT *, CASE WHEN kinship IS NULL THEN 'NA' WHEN kinship > 0.354 THEN 'duplicate/MZ'
      WHEN kinship > 0.177 THEN CASE WHEN ibs0 <= 0.005 THEN 'parent-offspring' ELSE 'full-sibling' END
      WHEN kinship > 0.0884 THEN '2nd-degree' WHEN kinship > 0.0442 THEN '3rd-degree' ELSE 'unrelated' END AS inferred,
    CASE WHEN split_part(id1, '_', 2) <> split_part(id2, '_', 2) THEN 'unrelated'
      WHEN {LETTER.format(x='id1')} IN ('F','M') AND {LETTER.format(x='id2')} IN ('F','M') THEN 'unrelated'
      WHEN {LETTER.format(x='id1')} NOT IN ('F','M','S') OR {LETTER.format(x='id2')} NOT IN ('F','M','S') THEN 'unknown'
      WHEN {LETTER.format(x='id1')} = 'S' AND {LETTER.format(x='id2')} = 'S' THEN 'full-sibling' ELSE 'parent-offspring' END AS known FROM j)"""


@query("agg50_classify_pairs", f"WITH {CLASSED} SELECT id1, id2, inferred, known, inferred = known AS agree FROM k")
def _(t):
    return kin.classify_pairs(kin.join_pairs(*two_sides(t))).select("id1", "id2", "inferred", "known", "agree")


@query(
    "agg50_agreement",
    f"""WITH {CLASSED} SELECT known, count(*) AS n_pairs, count(*) FILTER (WHERE inferred = known) AS n_agree,
          round(avg(CASE WHEN inferred = known THEN 1.0 ELSE 0.0 END), 9) AS agreement FROM k WHERE known <> 'unknown' GROUP BY known""",
)
def _(t):
    return rounded(kin.agreement(kin.classify_pairs(kin.join_pairs(*two_sides(t)))))


@query(
    "agg49_pairwise_ibs",
    """WITH d AS (SELECT sample, chrom, pos, CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 ELSE 2 END AS d FROM calls),
       p AS (SELECT a.sample AS id1, b.sample AS id2, count(*) AS n, count(*) FILTER (WHERE abs(a.d - b.d) = 2) AS z,
               count(*) FILTER (WHERE a.d = 1 AND b.d = 1) AS h, count(*) FILTER (WHERE a.d = 1) + count(*) FILTER (WHERE b.d = 1) AS s
             FROM d a JOIN d b ON b.chrom = a.chrom AND b.pos = a.pos AND a.sample < b.sample GROUP BY 1, 2)
       SELECT id1, id2, n AS n_snp, round(z / n, 9) AS ibs0, CASE WHEN s > 0 THEN round((h - 2 * z) / s, 9) END AS kinship FROM p""",
)
def _(t):
    return rounded(kin.pairwise_ibs(t.calls))
