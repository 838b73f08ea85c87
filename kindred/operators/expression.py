"""Expression matrices, search hits, feature coverage and gene-level flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.special import fisher_p
from ..plans.cut import cut_lineage
from ..plans.lookup import lookup_join
from ..plans.running import exact_quantiles
from ..plans.spans import point_in_span


def tpm(counts: DataFrame) -> DataFrame:
    """Transcripts per million per sample; genes of length 0 get 0.

    The samples' totals are stored and measured, and broadcast within the bounds of
    ``lookup_join``: the counts are summed where they are and not moved again.
    """
    rpk = F.when(F.col("length") > 0, F.col("count") / (F.col("length") / 1000.0))
    rows = counts.withColumn("__rpk", rpk)
    scale = rows.groupBy("sample").agg((F.sum("__rpk") / 1e6).alias("__scale"))
    return (
        lookup_join(rows, cut_lineage(scale), ["sample"])
        .withColumn(
            "tpm",
            F.when(F.col("length") > 0, F.col("__rpk") / F.col("__scale")).otherwise(F.lit(0.0)),
        )
        .drop("__rpk", "__scale")
    )


def expressed_counts(values: DataFrame, threshold: float = 1.0) -> DataFrame:
    return values.groupBy("sample").agg(F.count_if(F.col("tpm") > threshold).alias("n_expressed"))


def set_enrichment(values: DataFrame, gene_set: DataFrame, threshold: float = 1.0, p_values: bool = True) -> DataFrame:
    """Expressed share inside a gene set against the background, per sample."""
    tagged = lookup_join(values, gene_set.select("gene", F.lit(True).alias("__in")), ["gene"], "left")
    inside = F.coalesce("__in", F.lit(False))
    on = F.col("tpm") > threshold
    table = tagged.groupBy("sample").agg(
        F.count_if(inside & on).alias("set_expressed"),
        F.count_if(inside).alias("set_total"),
        F.avg(F.when(inside, F.col("tpm"))).alias("set_mean"),
        F.count_if(~inside & on).alias("bg_expressed"),
        F.count_if(~inside).alias("bg_total"),
        F.avg(F.when(~inside, F.col("tpm"))).alias("bg_mean"),
    )
    median = exact_quantiles(tagged.filter(inside), ["sample"], "tpm", {"set_median": 0.5})
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = (
        table.join(median, "sample", "left")
        .withColumn("set_share", share("set_expressed", "set_total"))
        .withColumn("bg_share", share("bg_expressed", "bg_total"))
        .withColumn("fold", F.when(F.col("bg_share") > 0, F.col("set_share") / F.col("bg_share")))
    )
    if not p_values:
        return out
    a, b = F.col("set_expressed"), F.col("set_total") - F.col("set_expressed")
    c, d = F.col("bg_expressed"), F.col("bg_total") - F.col("bg_expressed")
    return out.withColumn("p_greater", fisher_p(a, b, c, d)["greater"])


def top_variable_genes(values: DataFrame, gene_set: DataFrame, n: int = 100, threshold: float = 1.0) -> DataFrame:
    """Top genes of the set by variance of log2(TPM + 1), expressed in some sample."""
    inside = lookup_join(values, gene_set.select("gene"), ["gene"])
    return (
        inside.groupBy("gene")
        .agg(
            F.max("tpm").alias("__max"),
            F.var_samp(F.log2(F.col("tpm") + 1)).alias("variance"),
        )
        .filter((F.col("__max") > threshold) & F.col("variance").isNotNull())
        .drop("__max")
        .orderBy(F.desc("variance"), "gene")
        .limit(n)
    )


def filter_hits(hits: DataFrame, max_evalue: float, min_identity: float, min_coverage: float) -> DataFrame:
    """Thresholds on e-value, identity and query coverage in percent."""
    coverage = (F.col("qend") - F.col("qstart") + 1) / F.col("qlen") * 100
    return hits.withColumn("coverage", coverage).filter(
        (F.col("evalue") <= max_evalue)
        & (F.col("pident") >= min_identity)
        & (F.col("coverage") >= min_coverage)
    )


def best_hit(hits: DataFrame, order: list[str]) -> DataFrame:
    """Highest bit score per query gene (first in ``order`` on a tie) and the hit count."""
    named = hits.withColumn("query_gene", ids.protein_gene("qseqid")).withColumn(
        "target_gene", ids.transcript_gene("sseqid")
    )
    first = F.struct((-F.col("bitscore")).alias("s"), *[F.col(o) for o in order])
    return (
        named.groupBy("query_gene")
        .agg(
            F.min_by(F.struct("target_gene", "bitscore", "pident", "coverage"), first).alias("b"),
            F.count("*").alias("hit_count"),
        )
        .select("query_gene", "b.*", "hit_count")
    )


def orthogroup_lookup(queries: DataFrame, groups: DataFrame, gene: str = "gene", group: str = "group_id", members: str = "members") -> DataFrame:
    """Groups of the query genes, with every member gene of the group's ', ' list."""
    exploded = groups.select(group, F.explode(F.split(members, ", ")).alias("member"))
    hit = queries.join(exploded, queries[gene] == exploded["member"]).select(queries[gene], group)
    return hit.distinct().join(exploded, group)


def feature_coverage(calls: DataFrame, features: DataFrame, mean_depth: DataFrame) -> DataFrame:
    """Mean of depth over the sample's mean depth, per sample and feature.

    Integer depths are summed and divided once, so the result does not depend on the order of
    summation; the sample's mean is joined to the aggregated rows.
    """
    points = calls.filter("dp IS NOT NULL").select("chrom", (F.col("pos") - 1).alias("__p"), "sample", "dp")
    bed = features.select("chrom", (F.col("start") - 1).alias("start"), "stop", "feature_id", "feature_type")
    summed = (
        point_in_span(points, bed, ["chrom"], "__p", end="stop", salts=8)
        .groupBy("sample", "feature_id", "feature_type")
        .agg(F.sum("dp").alias("__total"), F.count("*").alias("__n"))
    )
    ratio = F.col("__total") / (F.col("__n") * F.col("mean_depth"))
    return summed.join(mean_depth.select("sample", "mean_depth"), "sample").select(
        "sample", "feature_id", "feature_type", ratio.alias("mean_scaled_dp")
    )


def unique_absence(coverage: DataFrame, target: str, threshold: float = 0.05) -> DataFrame:
    """Gene flag: some exon below the threshold in the target and at or above it in all others.

    Genes without exon rows stay with 0; a NULL coverage fails the comparison it is in.
    """
    mine, v = F.col("sample") == target, F.col("mean_scaled_dp")
    exon = F.col("feature_type") == "exon"
    per = coverage.groupBy(ids.feature_gene("feature_id").alias("gene"), "feature_id").agg(
        F.bool_or(exon & mine & (v < threshold)).alias("__absent"),
        F.bool_and(F.when(exon & ~mine, F.coalesce(v >= threshold, F.lit(False)))).alias("__others"),
    )
    flag = F.coalesce("__absent", F.lit(False)) & F.coalesce("__others", F.lit(True))
    return per.groupBy("gene").agg(F.max(flag.cast("int")).alias("unique_absent"))


def bias_counts(table: DataFrame, mode: str = "log2fc_threshold", threshold: float = 1.0) -> DataFrame:
    """Counts per pathway, direction and consistency.

    ``mode``: 'log2fc_threshold' (|log2fc| above the threshold) or 'significance' (``is_sig``).
    """
    lfc = F.col("log2fc")
    if mode == "log2fc_threshold":
        up, down = lfc > threshold, lfc < -threshold
    else:
        up, down = F.col("is_sig") & (lfc > 0), F.col("is_sig") & (lfc < 0)
    bias = F.when(up, "positive").when(down, "negative").otherwise("unbiased")
    consistent = (F.col("bias") == "unbiased") | (F.col("n_consistent") == F.col("n_species"))
    return (
        table.withColumn("bias", bias)
        .withColumn("consistent", consistent)
        .groupBy("pathway", "bias", "consistent")
        .agg(F.count("*").alias("n"))
    )
