"""Depth, callable genome, contig and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as cov
from ..operators import regions as rg
from ..plans import spans
from .core import query, rounded

X = ["c_11", "c_12"]


@query(
    "agg02_window_counts",
    """WITH w AS (SELECT chrom, length, unnest(range(1, length + 1, 5000)) AS window_start FROM chrom_len),
       n AS (SELECT chrom, (pos - 1) // 5000 * 5000 + 1 AS window_start, count(*) AS n FROM calls GROUP BY 1, 2)
       SELECT w.chrom, w.window_start, least(w.window_start + 4999, w.length) AS window_end, coalesce(n.n, 0) AS n
       FROM w LEFT JOIN n ON n.chrom = w.chrom AND n.window_start = w.window_start""",
)
def _(t):
    return cov.window_counts(t.calls, t.chrom_len, 5000)


@query(
    "agg03_merge_partials",
    """SELECT species, trinuc, CAST(sum(n) AS BIGINT) AS n FROM trinuc GROUP BY species, trinuc""",
)
def _(t):
    return cov.merge_partials(t.trinuc, ["species", "trinuc"], "n")


@query(
    "agg04_callable_per_individual",
    """SELECT child, CAST(sum(bp) AS BIGINT) AS callable_bp,
              round(100.0 * sum(bp) / (SELECT sum(length) FROM chrom_len WHERE chrom NOT IN ('c_11', 'c_12')), 9) AS percent
       FROM callable_bp WHERE chrom NOT IN ('c_11', 'c_12') GROUP BY child""",
)
def _(t):
    return rounded(cov.callable_per_individual(t.callable_bp, t.chrom_len, X))


CHROMS = [f"c_{i}" for i in range(1, 13)]


@query(
    "agg05_callable_fraction_matrix",
    "SELECT child, "
    + ", ".join(
        f"max(CASE WHEN b.chrom = '{c}' THEN round(CAST(bp AS DOUBLE) / length, 9) END) AS {c}"
        for c in CHROMS
    )
    + " FROM callable_bp b JOIN chrom_len l ON l.chrom = b.chrom GROUP BY child",
)
def _(t):
    return rounded(cov.callable_fraction_matrix(t.callable_bp, t.chrom_len, CHROMS))


@query(
    "agg12_ad_histogram",
    """WITH h AS (SELECT sample, chrom, CAST(alt_dp AS DOUBLE) / (ref_dp + alt_dp) AS f FROM calls
                  WHERE gt = '0/1' AND ref_dp + alt_dp > 0),
       e AS (SELECT i AS bin, i / 100.0::DOUBLE AS lo, (i + 1) / 100.0::DOUBLE AS hi FROM range(0, 100) r(i)),
       k AS (SELECT DISTINCT sample, chrom FROM h)
       SELECT k.sample, k.chrom, CAST(e.bin AS INT) AS bin, count(h.f) AS count
       FROM k CROSS JOIN e LEFT JOIN h ON h.sample = k.sample AND h.chrom = k.chrom
         AND ((h.f >= e.lo AND h.f < e.hi) OR (h.f = 1.0 AND e.bin = 99))
       GROUP BY 1, 2, 3""",
)
def _(t):
    return cov.ad_histogram(t.calls.filter("gt = '0/1'"), ["sample", "chrom"])


@query(
    "agg13_depth_mean_std",
    """SELECT sample, chrom, count(dp) AS n_sites, round(avg(dp), 9) AS mean_depth,
              round(stddev_pop(dp), 9) AS std_depth FROM calls GROUP BY sample, chrom""",
)
def _(t):
    return rounded(cov.depth_mean_std(t.calls, ["sample", "chrom"]))


@query(
    "agg14_depth_quantiles",
    """SELECT chrom, count(*) AS n, round(avg(depth), 9) AS mean, quantile_cont(depth, 0.5) AS median,
              round(quantile_cont(depth, 0.025), 9) AS q025, round(quantile_cont(depth, 0.25), 9) AS q25,
              round(quantile_cont(depth, 0.75), 9) AS q75, round(quantile_cont(depth, 0.975), 9) AS q975
       FROM depth GROUP BY chrom""",
)
def _(t):
    return rounded(cov.depth_quantiles(t.depth, ["chrom"]))


@query(
    "agg15_coverage_stats",
    """SELECT s.sample, l.chrom, max(l.length) AS length,
              count(*) FILTER (WHERE depth >= 1) AS covered_bases,
              CAST(coalesce(sum(depth) FILTER (WHERE depth >= 1), 0) AS BIGINT) AS total_depth,
              quantile_cont(depth, 0.5) FILTER (WHERE depth >= 1) AS median_covered,
              round(coalesce(sum(depth) FILTER (WHERE depth >= 1), 0) / max(l.length), 9) AS mean_all,
              round(avg(depth) FILTER (WHERE depth >= 1), 9) AS mean_covered
       FROM (SELECT DISTINCT sample FROM depth) s CROSS JOIN chrom_len l
       LEFT JOIN depth d ON d.chrom = l.chrom AND d.sample = s.sample GROUP BY s.sample, l.chrom""",
)
def _(t):
    return rounded(cov.coverage_stats(t.depth, t.chrom_len))


DP = "CASE WHEN gq % 7 = 0 THEN NULL WHEN gq % 5 = 0 THEN 0 ELSE dp END"


@query(
    "agg16_dp_stats",
    f"""SELECT sample, chrom, count(*) AS n_sites, round(avg(coalesce(v, 0)), 9) AS mean_all,
               quantile_cont(coalesce(v, 0), 0.5) AS median_all, round(avg(v) FILTER (WHERE v >= 1), 9) AS mean_covered,
               quantile_cont(v, 0.5) FILTER (WHERE v >= 1) AS median_covered
        FROM (SELECT sample, chrom, {DP} AS v FROM calls) z GROUP BY sample, chrom""",
)
def _(t):
    gappy = t.calls.withColumn("dp", F.expr(DP))
    return rounded(cov.dp_stats(gappy, ["sample", "chrom"]))


@query(
    "agg17_dp_histogram",
    "SELECT sample, dp, count(*) AS count FROM calls GROUP BY sample, dp",
)
def _(t):
    return cov.depth_histogram(t.calls, ["sample"])


@query(
    "agg17_pooled_stats",
    """SELECT sample, count(*) AS n, round(avg(dp), 9) AS mean, quantile_cont(dp, 0.5) AS median
       FROM calls WHERE chrom NOT IN ('c_11', 'c_12') GROUP BY sample""",
)
def _(t):
    shards = cov.depth_histogram(t.calls.filter(~F.col("chrom").isin(*X)), ["sample", "chrom"])
    return rounded(cov.histogram_stats(cov.merge_histograms(shards, ["sample"]), ["sample"]))


HIST = "SELECT chrom, depth, CAST(sum(stop - start) AS BIGINT) AS count FROM ivals WHERE stop > start GROUP BY chrom, depth"


@query(
    "agg18_weighted_depth",
    f"""WITH h AS ({HIST}),
        c AS (SELECT *, sum(count) OVER (PARTITION BY chrom ORDER BY depth) AS cum,
                     sum(count) OVER (PARTITION BY chrom) AS n FROM h WHERE depth > 0),
        q AS (SELECT chrom, min(depth) FILTER (WHERE cum >= 0.05 * n) AS p05, min(depth) FILTER (WHERE cum >= 0.25 * n) AS p25,
                     min(depth) FILTER (WHERE cum >= 0.5 * n) AS p50, min(depth) FILTER (WHERE cum >= 0.75 * n) AS p75,
                     min(depth) FILTER (WHERE cum >= 0.95 * n) AS p95 FROM c GROUP BY chrom)
        SELECT h.chrom, CAST(sum(count) AS BIGINT) AS total_bases,
               CAST(sum(count) FILTER (WHERE depth > 0) AS BIGINT) AS covered_bases,
               round(sum(depth * count) FILTER (WHERE depth > 0) / sum(count) FILTER (WHERE depth > 0), 9) AS covered_mean,
               any_value(p05) AS p05, any_value(p25) AS p25, any_value(p50) AS p50, any_value(p75) AS p75, any_value(p95) AS p95,
               round(sum(count) FILTER (WHERE depth > 0) / sum(count), 9) AS covered_fraction
        FROM h JOIN q ON q.chrom = h.chrom GROUP BY h.chrom""",
)
def _(t):
    return rounded(cov.weighted_depth(t.ivals, ["chrom"], end="stop"))


@query(
    "agg19_callable_bounds",
    f"""WITH h AS ({HIST}),
        c AS (SELECT *, sum(count) OVER (PARTITION BY chrom ORDER BY depth) AS cum,
                     sum(count) OVER (PARTITION BY chrom) AS n FROM h WHERE depth > 0),
        q AS (SELECT chrom, min(depth) FILTER (WHERE cum >= 0.5 * n) AS p50 FROM c GROUP BY chrom)
        SELECT chrom, p50, greatest(5, CAST(ceil(0.5 * p50) AS BIGINT)) AS callable_min,
               CAST(floor(2.0 * p50) AS BIGINT) AS callable_max FROM q""",
)
def _(t):
    stats = cov.weighted_depth(t.ivals, ["chrom"], end="stop")
    return cov.callable_bounds(stats).select("chrom", "p50", "callable_min", "callable_max")


@query(
    "agg26_nx_contigs",
    """WITH l AS (SELECT chrom, length(c) AS length FROM (
           SELECT chrom, unnest(string_split(substr(seq, 2, 32), 'N')) AS c FROM genome) z WHERE length(c) > 0),
       r AS (SELECT *, sum(length) OVER (PARTITION BY chrom ORDER BY length DESC, rowid_ ROWS UNBOUNDED PRECEDING) AS cum,
               sum(length) OVER (PARTITION BY chrom) AS total FROM (SELECT *, row_number() OVER () AS rowid_ FROM l) y)
       SELECT chrom, CAST(max(total) AS BIGINT) AS total_length, count(*) AS n_contigs,
              CAST(max(length) AS INT) AS longest, CAST(min(length) AS INT) AS shortest,
              CAST(max(CASE WHEN cum >= total * 0.5 THEN length END) AS INT) AS n50,
              CAST(max(CASE WHEN cum >= total * 0.9 THEN length END) AS INT) AS n90,
              CAST(max(CASE WHEN cum >= total * 0.95 THEN length END) AS INT) AS n95
       FROM r GROUP BY chrom""",
)
def _(t):
    own = t.genome.select("chrom", F.substring("seq", 2, 32).alias("seq"))
    return cov.nx(cov.contigs(own), ["chrom"])


@query(
    "agg27_length_bins",
    """SELECT length_class, count(*) AS n FROM (
         SELECT CASE WHEN length <= 3 THEN 'tiny' WHEN length <= 8 THEN 'short' WHEN length <= 16 THEN 'mid'
                     ELSE '>1Mb' END AS length_class
         FROM (SELECT length(c) AS length FROM (
                 SELECT unnest(string_split(substr(seq, 2, 32), 'N')) AS c FROM genome) z WHERE length(c) > 0) y) x
       GROUP BY length_class""",
)
def _(t):
    own = t.genome.select(F.substring("seq", 2, 32).alias("seq"))
    return cov.length_bins(cov.contigs(own), classes=((3, "tiny"), (8, "short"), (16, "mid")))


@query(
    "agg27_gc_content",
    """SELECT chrom, round(avg(100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq)), 9) AS mean_gc
       FROM genome GROUP BY chrom""",
)
def _(t):
    return rounded(t.genome.groupBy("chrom").agg(F.avg(cov.gc_content(F.col("seq"))).alias("mean_gc")))


WINDOWS = """w AS (SELECT chrom, pos // 5000 * 5000 + 1 AS window_start, count(*) AS callable_sites
                   FROM calls GROUP BY 1, 2),
             o AS (SELECT chrom, pos // 5000 * 5000 + 1 AS window_start, count(*) AS observed FROM calls
                   WHERE gt = '0/1' GROUP BY 1, 2)"""


def windows(t):
    start = (F.floor(F.col("pos") / 5000) * 5000 + 1).cast("bigint").alias("window_start")
    return t.calls.groupBy("chrom", start).agg(
        F.count("*").alias("callable_sites"), F.count_if(F.col("gt") == "0/1").alias("observed")
    )


@query(
    "agg55_window_enrichment",
    f"""WITH {WINDOWS}, m AS (SELECT w.*, coalesce(observed, 0) AS observed FROM w LEFT JOIN o
            ON o.chrom = w.chrom AND o.window_start = w.window_start),
        e AS (SELECT *, sum(observed) OVER (PARTITION BY chrom) * callable_sites
              / sum(callable_sites) OVER (PARTITION BY chrom) AS expected FROM m)
        SELECT chrom, window_start, callable_sites, observed, round(expected, 9) AS expected,
               CASE WHEN expected > 0 THEN round(observed / expected, 9) END AS enrichment FROM e""",
)
def _(t):
    return rounded(cov.window_enrichment(windows(t), keys=["chrom"]))


@query(
    "agg56_grand_mean",
    """SELECT sample, mean_depth, grand_mean FROM (
         SELECT sample, round(avg(depth), 9) AS mean_depth FROM depth GROUP BY sample
         UNION ALL SELECT sample, round(avg(dp), 9) FROM calls GROUP BY sample) x
       CROSS JOIN (SELECT round(avg(m), 9) AS grand_mean FROM (
         SELECT avg(depth) AS m FROM depth GROUP BY sample
         UNION ALL SELECT avg(dp) FROM calls GROUP BY sample) y) z""",
)
def _(t):
    a = t.depth.groupBy("sample").agg(F.avg("depth").alias("mean_depth"))
    b = t.calls.groupBy("sample").agg(F.avg("dp").alias("mean_depth"))
    return rounded(cov.grand_mean([a, b], "mean_depth"))


@query(
    "agg59_callable_range_share",
    f"""WITH h AS ({HIST}),
        c AS (SELECT *, sum(count) OVER (PARTITION BY chrom ORDER BY depth) AS cum,
                     sum(count) OVER (PARTITION BY chrom) AS n FROM h WHERE depth > 0),
        q AS (SELECT chrom, min(depth) FILTER (WHERE cum >= 0.5 * n) AS p50 FROM c GROUP BY chrom)
        SELECT c.chrom, round(sum(count / n) FILTER (WHERE depth BETWEEN greatest(5, ceil(0.5 * p50)) AND floor(2.0 * p50)), 9) AS in_range
        FROM c JOIN q ON q.chrom = c.chrom GROUP BY c.chrom""",
)
def _(t):
    hist = cov.run_depth_histogram(t.ivals, ["chrom"], end="stop")
    bounds = cov.callable_bounds(cov.weighted_depth(t.ivals, ["chrom"], end="stop"))
    return rounded(
        cov.callable_range_share(cov.cumulative_distribution(hist, ["chrom"]), bounds, ["chrom"])
    )


@query(
    "win14_cumulative_distribution",
    f"""WITH h AS ({HIST})
        SELECT chrom, depth, count, CAST(sum(count) OVER (PARTITION BY chrom) AS BIGINT) AS n_covered,
               CAST(sum(count) OVER (PARTITION BY chrom ORDER BY depth) AS BIGINT) AS cumulative,
               round(count / sum(count) OVER (PARTITION BY chrom), 9) AS frac,
               round(sum(count) OVER (PARTITION BY chrom ORDER BY depth) / sum(count) OVER (PARTITION BY chrom), 9) AS cumulative_frac
        FROM h WHERE depth > 0""",
)
def _(t):
    hist = cov.run_depth_histogram(t.ivals, ["chrom"], end="stop")
    return rounded(cov.cumulative_distribution(hist, ["chrom"]))


# --- intervals ------------------------------------------------------------------------------


def islands(source: str, gap: int, keys: str) -> str:
    return f"""z AS (SELECT *, max(stop) OVER (PARTITION BY {keys} ORDER BY start, stop
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
             y AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + {gap} THEN 1 ELSE 0 END)
                       OVER (PARTITION BY {keys} ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM z),
             x AS (SELECT {keys}, min(start) AS start, max(stop) AS stop, CAST(sum(stop - start) AS BIGINT) AS covered
                   FROM y GROUP BY {keys}, island)"""


@query(
    "win01_points_to_spans",
    f"""WITH s AS (SELECT DISTINCT chrom, pos - 1 AS start, pos AS stop FROM calls), {islands('s', 29, 'chrom')}
        SELECT chrom, start, stop, covered FROM x""",
)
def _(t):
    return spans.points_to_spans(t.calls, ["chrom"], "pos", 30, width=512).withColumnRenamed("end", "stop")


@query(
    "win02_union_intervals",
    f"WITH {islands('ivals', 0, 'chrom')} SELECT chrom, start, stop FROM x",
)
def _(t):
    return spans.merge_spans(t.ivals, ["chrom"], 0, end="stop").drop("covered")


@query(
    "win03_bridge_intervals",
    f"""WITH u AS (SELECT chrom, start, stop FROM ivals),
        {islands('u', 0, 'chrom').replace('z AS', 'z0 AS').replace('y AS', 'y0 AS').replace('x AS', 'x0 AS').replace('FROM z)', 'FROM z0)').replace('FROM y ', 'FROM y0 ')},
        {islands('x0', 100, 'chrom')}
        SELECT chrom, start, stop, covered, round(covered / (stop - start), 9) AS callable_fraction FROM x""",
)
def _(t):
    disjoint = spans.merge_spans(t.ivals, ["chrom"], 0, end="stop").drop("covered")
    return rounded(rg.bridge_intervals(disjoint, ["chrom"], 100, end="stop"))


@query(
    "win04_merge_two_beds",
    f"""WITH u AS (SELECT chrom, start, stop FROM ivals UNION ALL SELECT chrom, start - 1, stop FROM features),
        {islands('u', 0, 'chrom')} SELECT chrom, start, stop FROM x""",
)
def _(t):
    bed = t.features.select("chrom", (F.col("start") - 1).alias("start"), "stop")
    return rg.merge_two(t.ivals, bed, ["chrom"], end="stop")


@query(
    "win05_nearest_neighbour",
    """WITH g AS (SELECT user_id, pos, pos - lag(pos) OVER w AS l, lead(pos) OVER w - pos AS r FROM points
                  WINDOW w AS (PARTITION BY user_id ORDER BY pos))
       SELECT user_id, count(*) AS n_points, round(avg(least(l, r)), 9) AS mean_distance FROM g
       WHERE l IS NOT NULL OR r IS NOT NULL GROUP BY user_id""",
)
def _(t):
    return rounded(rg.mean_nearest_neighbour(t.points, ["user_id"], ["user_id"]))


RUN_SITES = """sites_ AS (SELECT chrom, pos, bool_or(dp < 25) AS removed, bool_or(gt = '0/1') AS poly
               FROM calls GROUP BY chrom, pos)"""


def masked_sites(t):
    return t.calls.groupBy("chrom", "pos").agg(
        F.bool_or(F.col("dp") < 25).alias("removed"), F.bool_or(F.col("gt") == "0/1").alias("poly")
    )


RUNS = f"""WITH {RUN_SITES},
    e AS (SELECT *, min(CASE WHEN removed THEN pos END) OVER (PARTITION BY chrom ORDER BY pos DESC) AS nxt FROM sites_),
    b AS (SELECT chrom, nxt, min(pos) AS start, coalesce(nxt, max(pos) + 1) AS stop FROM e WHERE NOT removed GROUP BY chrom, nxt),
    p AS (SELECT b.chrom, b.start, b.stop, count(*) FILTER (WHERE s.poly) AS n_poly
          FROM b JOIN sites_ s ON s.chrom = b.chrom AND s.pos BETWEEN b.start AND b.stop GROUP BY ALL)"""


@query(
    "win07_runs",
    RUNS + " SELECT chrom, start, stop, n_poly, round(n_poly / (stop - start + 1), 9) AS poly_stat FROM p",
)
def _(t):
    out = rg.runs(masked_sites(t), ["chrom"], "pos", "removed", "poly", width=1024)
    return rounded(out.withColumnRenamed("end", "stop"))


@query(
    "win07_runs_last_again",
    RUNS + """, z AS (SELECT chrom, max(pos) AS last, max_by(poly, pos) AS again FROM sites_ GROUP BY chrom),
        r AS (SELECT p.chrom, start, stop, n_poly, n_poly + CASE WHEN stop = last + 1 AND again THEN 1 ELSE 0 END AS n_again FROM p JOIN z USING (chrom))
       SELECT chrom, start, stop, n_poly AS n_once, n_again, round(n_again / (stop - start + 1), 9) AS poly_stat FROM r""",
)
def _(t):
    """The two rules for the last site of a chromosome side by side."""
    args = (masked_sites(t), ["chrom"], "pos", "removed", "poly")
    once = rg.runs(*args).select("chrom", "start", F.col("n_poly").alias("n_once"))
    again = rg.runs(*args, last_again=True).withColumnsRenamed({"end": "stop", "n_poly": "n_again"})
    return rounded(again.join(once, ["chrom", "start"]))


@query(
    "flt22_region_filter",
    RUNS + """ SELECT chrom, start, stop - 1 AS stop, stop - start AS len, round(n_poly / (stop - start + 1), 9) AS poly_stat
               FROM p WHERE log10(stop - start) > 1.5 AND n_poly / (stop - start + 1) < 0.15""",
)
def _(t):
    regions = rg.runs(masked_sites(t), ["chrom"], "pos", "removed", "poly")
    out = rg.region_filter(regions, 1.5, 0.15)
    return rounded(
        out.select("chrom", "start", F.col("end").alias("stop"), "len", "poly_stat")
    )


@query(
    "win11_dense_codes",
    """SELECT chrom AS original, CAST(row_number() OVER (ORDER BY m) AS INT) AS code FROM (
         SELECT 'c_' || CAST(o_custkey % 12 + 1 AS VARCHAR) AS chrom, min(o_orderkey) AS m FROM orders GROUP BY 1) z""",
)
def _(t):
    return rg.dense_codes(t.sites, "chrom", "pos")


SEGMENTS = """s AS (SELECT chrom, length, unnest(range(1, length + 1, 5000)) AS start FROM chrom_len),
   o AS (SELECT *, row_number() OVER (ORDER BY CAST(split_part(chrom, '_', 2) AS INT), start) - 1 AS i FROM s)"""


@query(
    "win12_make_segments",
    f"""WITH {SEGMENTS} SELECT chrom, start, least(start + 4999, length) AS stop,
          'SP_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS segment_id,
          chrom || ':' || start || '-' || least(start + 4999, length) AS interval FROM o""",
)
def _(t):
    return rg.make_segments(t.chrom_len, 5000, "SP").withColumnRenamed("end", "stop")


@query(
    "srt01_chromosome_order",
    "SELECT chrom, length, row_number() OVER (ORDER BY CAST(split_part(chrom, '_', 2) AS INT)) AS place FROM chrom_len",
)
def _(t):
    return rg.with_chromosome_place(t.chrom_len)


@query(
    "jn03_near_other",
    """WITH q AS (SELECT DISTINCT user_id, pos FROM points WHERE event_type = 'error'),
       d AS (SELECT DISTINCT user_id, pos FROM points WHERE event_type <> 'error')
       SELECT user_id, pos FROM q WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = q.user_id
         AND d.pos <> q.pos AND abs(d.pos - q.pos) <= 1500)""",
)
def _(t):
    q = t.points.filter("event_type = 'error'").select("user_id", "pos").distinct()
    d = t.points.filter("event_type <> 'error'")
    near = spans.near_other(q, d, ["user_id"], "pos", 1500)
    return q.join(near, ["user_id", "pos"], "left_anti")


@query(
    "jn04_point_in_interval",
    """SELECT c.chrom, c.pos, c.sample, f.feature_id FROM calls c JOIN features f
       ON f.chrom = c.chrom AND c.pos BETWEEN f.start AND f.stop""",
)
def _(t):
    bed = t.features.withColumn("start", F.col("start") - 1)
    points = t.calls.select("chrom", (F.col("pos") - 1).alias("pos0"), "pos", "sample")
    return spans.point_in_span(points, bed, ["chrom"], "pos0", end="stop").select(
        "chrom", "pos", "sample", "feature_id"
    )
