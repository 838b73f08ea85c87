"""Test and replicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls as fc
from ..operators import hypothesis as hy
from ..operators import phasing as ph
from ..operators import regions as rg
from ..operators import replicates as rp
from ..operators import spectrum as sp
from ..plans import spans
from ..plans.draws import duck_hash_int, duck_uniform
from .core import query, rounded
from .coverage import WINDOWS, islands, windows
from .spectrum import LAB, MUT, units

SEED = 42


def chi2_p(x: str, k: str, terms: int = 3000) -> str:
    """Upper tail of chi-square in the oracle, from the series of the lower gamma function."""
    return (
        f"round(greatest(0, 1 - list_sum([exp(-({x}) / 2 + (({k}) / 2.0 + i) * ln(greatest({x}, 1e-300) / 2) - lgamma(({k}) / 2.0 + i + 1))"
        f" for i in range(0, {terms})])), 6)"
    )


def p6(df, *cols):
    """p-values to 6 digits, other doubles to 9."""
    return df.select(
        *[
            F.round(c, 6 if c in cols else 9).alias(c) if ty == "double" else F.col(c)
            for c, ty in df.dtypes
        ]
    )


# --- tests ------------------------------------------------------------------------------------


@query(
    "tst02_chi2_gof",
    f"""WITH {WINDOWS}, m AS (SELECT w.*, coalesce(observed, 0) AS observed FROM w LEFT JOIN o ON o.chrom = w.chrom AND o.window_start = w.window_start),
        e AS (SELECT *, sum(observed) OVER (PARTITION BY chrom) * callable_sites / sum(callable_sites) OVER (PARTITION BY chrom) AS expected FROM m),
        x AS (SELECT chrom, sum((observed - expected) ** 2 / expected) AS c, count(*) - 1 AS dof FROM e WHERE expected > 0 GROUP BY chrom)
        SELECT chrom, round(c, 9) AS chi2, dof, CASE WHEN dof > 0 THEN {chi2_p('c', 'dof', 600)} END AS p_value FROM x""",
)
def _(t):
    from ..operators.coverage import window_enrichment

    return p6(hy.chi2_gof(window_enrichment(windows(t), keys=["chrom"]), ["chrom"], "observed", "expected"), "p_value")


@query(
    "tst03_chi2_contingency",
    f"""WITH n AS (SELECT l_suppkey % 10 AS k, l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
        e AS (SELECT *, sum(n) OVER (PARTITION BY k, r) * sum(n) OVER (PARTITION BY k, c) / sum(n) OVER (PARTITION BY k) AS e FROM n),
        x AS (SELECT k, sum((n - e) ** 2 / e) AS s FROM e GROUP BY k)
        SELECT k, CAST(2 AS BIGINT) AS dof, round(s, 9) AS chi2, {chi2_p('s', '2', 600)} AS p_value FROM x""",
)
def _(t):
    n = t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("k"), "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return p6(hy.chi2_contingency(n, ["k"], "l_returnflag", "l_linestatus", "n"), "p_value")


@query(
    "tst03_chi2_yates",
    f"""WITH q AS (SELECT test_key, stratum, a, b, c, d, (a + b + c + d) AS t, CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c AS det FROM cells),
        v AS (SELECT *, abs(det) / t AS gap FROM q WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0),
        x AS (SELECT *, (gap - least(0.5, gap)) ** 2 * (t / CAST((a + b) * (a + c) AS DOUBLE) + t / CAST((a + b) * (b + d) AS DOUBLE)
                + t / CAST((c + d) * (a + c) AS DOUBLE) + t / CAST((c + d) * (b + d) AS DOUBLE)) AS s FROM v)
        SELECT test_key, stratum, CAST(1 AS BIGINT) AS dof, round(s, 9) AS chi2, {chi2_p('s', '1', 600)} AS p_value FROM x""",
)
def _(t):
    cells = F.array(
        *[
            F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.col(x).alias("n"))
            for x, r, c in (("a", 1, 1), ("b", 1, 2), ("c", 2, 1), ("d", 2, 2))
        ]
    )
    long = t.cells.select("test_key", "stratum", F.explode(cells).alias("x")).select("test_key", "stratum", "x.*")
    out = hy.chi2_contingency(long, ["test_key", "stratum"], "r", "c", "n").filter("dof = 1")
    return p6(out, "p_value")


def lp(x: str) -> str:
    lc = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"
    return f"{lc('(a + b)', x)} + {lc('(c + d)', f'(a + c) - ({x})')} - {lc('(a + b + c + d)', '(a + c)')}"


@query(
    "tst04_fisher",
    f"""WITH q AS (SELECT test_key, stratum, a, b, c, d, greatest(0, (a + c) - (c + d)) AS lo, least(a + b, a + c) AS hi, {lp('a')} AS pa FROM cells)
        SELECT test_key, stratum, CASE WHEN b * c <> 0 THEN round(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c), 9) END AS odds_ratio,
          CASE WHEN a + b > 0 AND c + d > 0 THEN round(least(1, list_sum([CASE WHEN {lp('x')} <= pa + 1e-7 THEN exp({lp('x')}) ELSE 0 END for x in range(lo, hi + 1)])), 6) END AS p_two_sided,
          CASE WHEN a + b > 0 AND c + d > 0 THEN round(least(1, list_sum([CASE WHEN x >= a THEN exp({lp('x')}) ELSE 0 END for x in range(lo, hi + 1)])), 6) END AS p_greater FROM q""",
)
def _(t):
    out = hy.fisher_2x2(t.cells).select("test_key", "stratum", "odds_ratio", "p_two_sided", "p_greater")
    return p6(out, "p_two_sided", "p_greater")


CATEGORY = f"""WITH {LAB}, v AS (SELECT mc, count(*) FILTER (WHERE sociality = 'social') AS a, count(*) FILTER (WHERE sociality = 'subsocial') AS c
      FROM som JOIN species_dim s ON s.species = som.species GROUP BY mc),
    q AS (SELECT mc, a, sum(a) OVER () - a AS b, c, sum(c) OVER () - c AS d FROM v),
    w AS (SELECT *, greatest(0, (a + c) - (c + d)) AS lo, least(a + b, a + c) AS hi, {lp('a')} AS pa FROM q),
    p AS (SELECT *, least(1, list_sum([CASE WHEN {lp('x')} <= pa + 1e-7 THEN exp({lp('x')}) ELSE 0 END for x in range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)])) AS p FROM w),
    r AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM p),
    z AS (SELECT *, least(1, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r)"""


@query(
    "tst04_category_tests",
    CATEGORY
    + """ SELECT mc AS mutation_class, round(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c), 9) AS odds_ratio, round(p, 6) AS p_two_sided, round(adj, 6) AS p_adjusted,
            round(a / (a + b), 9) AS share_first, round(c / (c + d), 9) AS share_second FROM z""",
)
def _(t):
    rows = sp.labelled_somatic(t.somatic).join(t.species_dim.select("species", "sociality"), "species")
    table = rows.groupBy("mutation_class").agg(
        F.count_if(F.col("sociality") == "social").alias("social"),
        F.count_if(F.col("sociality") == "subsocial").alias("subsocial"),
    )
    out = hy.category_tests(table, [], "mutation_class", "social", "subsocial").select(
        "mutation_class", "odds_ratio", "p_two_sided", "p_adjusted", "share_first", "share_second"
    )
    return p6(out, "p_two_sided", "p_adjusted")


MH = """s AS (SELECT test_key, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d,
     CAST(a + b AS DOUBLE) AS n1, CAST(c + d AS DOUBLE) AS n2, CAST(a + c AS DOUBLE) AS m1, CAST(b + d AS DOUBLE) AS m2, CAST(a + b + c + d AS DOUBLE) AS n FROM cells)"""


@query(
    "tst05_cmh",
    f"""WITH {MH}, g AS (SELECT test_key, sum(a) AS sa, sum(n1 * m1 / n) AS se, sum(n1 * n2 * m1 * m2 / (n * n * (n - 1))) AS sv,
            sum(a * d / n) AS r, sum(b * c / n) AS q FROM s GROUP BY test_key), x AS (SELECT *, (abs(sa - se) - 0.5) ** 2 / sv AS x FROM g)
        SELECT test_key, round(x, 9) AS cmh_chi2, round(r / q, 9) AS or_mh, {chi2_p('x', '1', 400)} AS cmh_p FROM x""",
)
def _(t):
    return p6(hy.cmh(t.cells, ["test_key"]), "cmh_p")


@query(
    "tst06_breslow_day",
    f"""WITH {MH}, g AS (SELECT test_key, sum(a * d / n) / sum(b * c / n) AS o FROM s GROUP BY test_key),
        w AS (SELECT s.*, o, -(o * (n1 + m1) + (n2 - m1)) AS qb FROM s JOIN g ON g.test_key = s.test_key),
        z AS (SELECT *, sqrt(qb * qb - 4 * (o - 1) * o * n1 * m1) AS root FROM w),
        e AS (SELECT *, CASE WHEN (-qb - root) / (2 * (o - 1)) BETWEEN greatest(0, m1 - n2) AND least(n1, m1)
                THEN (-qb - root) / (2 * (o - 1)) ELSE (-qb + root) / (2 * (o - 1)) END AS e FROM z),
        v AS (SELECT *, 1 / (1 / e + 1 / (n1 - e) + 1 / (m1 - e) + 1 / (n2 - m1 + e)) AS v FROM e),
        f AS (SELECT test_key, o, sum((a - e) ** 2 / v) - sum(a - e) ** 2 / sum(v) AS x, count(*) - 1 AS dof FROM v GROUP BY test_key, o)
        SELECT test_key, round(o, 9) AS or_mh, round(x, 6) AS bd_chi2, dof, CASE WHEN dof > 0 THEN {chi2_p('x', 'dof', 400)} END AS bd_p FROM f""",
)
def _(t):
    out = hy.breslow_day(t.cells, ["test_key"])
    return p6(out, "bd_p", "bd_chi2")


@query(
    "tst07_poisson_interaction",
    f"""WITH q AS (SELECT test_key, stratum, CAST(a AS DOUBLE) AS y11, CAST(b AS DOUBLE) AS y12, CAST(c AS DOUBLE) AS y21, CAST(d AS DOUBLE) AS y22,
            100.0 + a AS e11, 150.0 + d AS e12, 90.0 + c AS e21, 200.0 + b AS e22 FROM cells),
        m AS (SELECT *, y11 + y12 AS n1, y21 + y22 AS n2, y11 + y21 AS m1, CAST(e11 AS DOUBLE) * e22 / (CAST(e12 AS DOUBLE) * e21) AS o FROM q),
        w AS (SELECT *, -(o * (n1 + m1) + (n2 - m1)) AS qb FROM m), z AS (SELECT *, sqrt(greatest(qb * qb - 4 * (o - 1) * o * n1 * m1, 0)) AS root FROM w),
        e AS (SELECT *, CASE WHEN abs(o - 1) < 1e-12 THEN n1 * m1 / (n1 + n2) WHEN (-qb - root) / (2 * (o - 1)) BETWEEN greatest(0, m1 - n2) AND least(n1, m1)
                THEN (-qb - root) / (2 * (o - 1)) ELSE (-qb + root) / (2 * (o - 1)) END AS f FROM z),
        x AS (SELECT test_key, stratum, 2 * (coalesce(CASE WHEN y11 > 0 THEN y11 * ln(y11 / f) END, 0) + coalesce(CASE WHEN y12 > 0 THEN y12 * ln(y12 / (n1 - f)) END, 0)
                + coalesce(CASE WHEN y21 > 0 THEN y21 * ln(y21 / (m1 - f)) END, 0) + coalesce(CASE WHEN y22 > 0 THEN y22 * ln(y22 / (n2 - m1 + f)) END, 0)) AS x FROM e)
        SELECT test_key, stratum, round(greatest(x, 0), 6) AS lrt_chi2, {chi2_p('greatest(x, 0)', '1', 400)} AS p_value FROM x""",
)
def _(t):
    rows = t.cells.select(
        "test_key", "stratum",
        *[F.col(x).alias(f"y{k}") for x, k in zip("abcd", ("11", "12", "21", "22"))],
        (F.col("a") + 100.0).alias("e11"), (F.col("d") + 150.0).alias("e12"),
        (F.col("c") + 90.0).alias("e21"), (F.col("b") + 200.0).alias("e22"),
    )
    out = hy.poisson_interaction(rows).select("test_key", "stratum", "lrt_chi2", "p_value")
    return p6(out, "lrt_chi2", "p_value")


CAT7 = [f"q{i}" for i in range(1, 8)]
IPF_STEP = """SELECT test_key, g, l, c, o, gt, gc, tc, m * gt / sum(m) OVER (PARTITION BY test_key, g, l) AS m, i FROM {src}"""


@query(
    "tst08_loglinear_3way",
    """WITH RECURSIVE raw AS (SELECT 'k' || CAST(l_suppkey % 8 AS VARCHAR) AS test_key, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS g,
              CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS l, l_linenumber AS c, count(*) AS o FROM lineitem GROUP BY ALL),
        base AS (SELECT *, sum(o) OVER (PARTITION BY test_key, g, l) AS gt, sum(o) OVER (PARTITION BY test_key, g, c) AS gc,
              sum(o) OVER (PARTITION BY test_key, l, c) AS tc FROM raw),
        it AS (SELECT test_key, g, l, c, o, gt, gc, tc, CAST(1 AS DOUBLE) AS m, 0 AS i FROM base
          UNION ALL SELECT test_key, g, l, c, o, gt, gc, tc, m * tc / sum(m) OVER (PARTITION BY test_key, l, c) AS m, i + 1 FROM (
            SELECT *  REPLACE (m * gc / sum(m) OVER (PARTITION BY test_key, g, c) AS m) FROM (
              SELECT * REPLACE (m * gt / sum(m) OVER (PARTITION BY test_key, g, l) AS m) FROM it WHERE i < 60) a) b),
        x AS (SELECT test_key, 2 * sum(o * ln(o / m)) AS x FROM it WHERE i = 60 GROUP BY test_key)
        SELECT test_key, round(x, 6) AS g2, 6 AS dof, """
    + chi2_p("x", "6", 400)
    + " AS p_value FROM x",
)
def _(t):
    rows = t.lineitem.select(
        F.concat(F.lit("k"), (F.col("l_suppkey") % 8).cast("string")).alias("test_key"),
        F.when(F.col("l_returnflag") == "A", "A").otherwise("B").alias("g"),
        F.when(F.col("l_linestatus") == "O", "O").otherwise("F").alias("l"),
        F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("c"),
        F.lit(1).alias("n"),
    )
    out = hy.loglinear_3way(rows, ["test_key"], "g", "l", "c", "n", ("A", "B"), ("O", "F"), CAT7)
    return p6(out, "g2", "p_value")


def normal_p(z: str) -> str:
    return chi2_p(f"({z}) * ({z})", "1", 400)


@query(
    "tst09_mann_whitney",
    f"""WITH r AS (SELECT species, sociality, v, rank() OVER (PARTITION BY lane ORDER BY v) + (count(*) OVER (PARTITION BY lane, v) - 1) / 2.0 AS r, lane,
             count(*) OVER (PARTITION BY lane, v) AS ties FROM (SELECT lane, species, coverage AS v, CASE WHEN species IN ('AFRICA','ASIA') THEN 'S' ELSE 'N' END AS sociality FROM lanes) q),
        s AS (SELECT lane, count(*) FILTER (WHERE sociality = 'S') AS n1, count(*) AS n, sum(r) FILTER (WHERE sociality = 'S') AS r1,
             sum(ties * ties - 1) AS tt FROM r GROUP BY lane),
        u AS (SELECT lane, n1, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2.0 AS u1,
             sqrt(n1 * (n - n1) / 12.0 * ((n + 1) - tt / (CAST(n AS DOUBLE) * (n - 1)))) AS sd FROM s),
        z AS (SELECT *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sd AS z FROM u)
        SELECT lane, n1, n2, CAST(u1 AS DOUBLE) AS u1, round(z, 9) AS z, {normal_p('z')} AS p_value FROM z""",
)
def _(t):
    out = hy.mann_whitney(t.lanes, ["lane"], "coverage", F.col("species").isin("AFRICA", "ASIA"))
    return p6(out, "p_value")


VEC = """v AS (SELECT label, CAST(i AS INT) AS dim, avg(CAST(embedding[CAST(i + 1 AS INT)] AS DOUBLE)) AS value
         FROM (SELECT label, embedding, unnest(range(0, 64)) AS i FROM embeddings) q GROUP BY 1, 2)"""
DIST = f"""{VEC}, n AS (SELECT label, sqrt(sum(value * value)) AS n FROM v GROUP BY label),
    d AS (SELECT CAST(a.label AS VARCHAR) AS a, CAST(b.label AS VARCHAR) AS b, 1 - sum(a.value * b.value) / (any_value(x.n) * any_value(y.n)) AS distance
      FROM v a JOIN v b ON b.dim = a.dim AND CAST(a.label AS VARCHAR) < CAST(b.label AS VARCHAR)
      JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label GROUP BY 1, 2)"""


def label_vectors(t):
    long = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "x"))
    return long.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


@query("jn17_cosine_pairs", f"WITH {DIST} SELECT a, b, round(distance, 9) AS distance FROM d")
def _(t):
    return rounded(hy.cosine_distance_pairs(label_vectors(t), "label", "dim", "value"))


@query(
    "jn17_near_pairs",
    """WITH v AS (SELECT l_suppkey AS e, l_partkey % 40 AS dim, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
        n AS (SELECT e, sqrt(sum(v * v)) AS norm FROM v GROUP BY e),
        d AS (SELECT a.e AS x, b.e AS y, 1 - sum(a.v / na.norm * (b.v / nb.norm)) AS distance FROM v a JOIN v b ON b.dim = a.dim AND CAST(a.e AS VARCHAR) < CAST(b.e AS VARCHAR)
              JOIN n na ON na.e = a.e JOIN n nb ON nb.e = b.e GROUP BY a.e, b.e)
       SELECT CAST(x AS VARCHAR) AS a, CAST(y AS VARCHAR) AS b, round(distance, 9) AS distance FROM d WHERE distance <= 0.17""",
)
def _(t):
    """Suppliers with alike quantities over parts; pairs beyond the distance never leave a task."""
    dims = (F.col("l_partkey") % 40).alias("dim")
    v = t.lineitem.groupBy(F.col("l_suppkey").alias("e"), dims).agg(F.sum("l_quantity").alias("v"))
    return rounded(hy.cosine_distance_pairs(v, "e", "dim", "v", most=0.17))


@query(
    "tst10_tree_distance",
    """WITH p AS (SELECT s_suppkey AS leaf, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['root', 'r' || n_regionkey, 's' || s_suppkey]
                    ELSE ['root', 'r' || n_regionkey, 'n' || n_nationkey, 's' || s_suppkey] END) AS ancestor,
                 unnest(range(0, CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 4 END)) AS depth
               FROM supplier JOIN nation ON n_nationkey = s_nationkey),
        w AS (SELECT DISTINCT least(x.l_suppkey, y.l_suppkey) AS a, greatest(x.l_suppkey, y.l_suppkey) AS b
              FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
              WHERE x.l_suppkey <> y.l_suppkey),
        l AS (SELECT leaf, max(depth) AS d FROM p GROUP BY leaf),
        c AS (SELECT w.a, w.b, max(x.depth) AS s FROM w JOIN p x ON x.leaf = w.a JOIN p y ON y.leaf = w.b AND y.ancestor = x.ancestor GROUP BY 1, 2)
       SELECT c.a, c.b, CAST(la.d + lb.d - 2 * c.s AS DOUBLE) AS distance FROM c JOIN l la ON la.leaf = c.a JOIN l lb ON lb.leaf = c.b""",
)
def _(t):
    """Steps in the tree of regions, nations and suppliers between suppliers of neighbouring order lines."""
    joined = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey"))  # 25 rows
    top = [F.lit("root"), F.concat(F.lit("r"), "n_regionkey")]
    own, nation = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "n_nationkey")
    line = F.when(F.col("s_suppkey") % 3 == 0, F.array(*top, own)).otherwise(F.array(*top, nation, own))
    paths = joined.select(F.col("s_suppkey").alias("leaf"), F.posexplode(line).alias("depth", "ancestor"))
    x = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("x"))
    y = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_suppkey").alias("y"))
    pairs = x.join(y, ["l_orderkey", "n"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return hy.tree_distance(paths, pairs)


@query(
    "tst10_distance_correlation",
    f"""WITH {DIST} SELECT round(corr(distance, abs(CAST(a AS INT) - CAST(b AS INT))), 9) AS r, count(*) AS n_pairs FROM d""",
)
def _(t):
    d = hy.cosine_distance_pairs(label_vectors(t), "label", "dim", "value")
    other = d.select("a", "b", F.abs(F.col("a").cast("int") - F.col("b").cast("int")).cast("double").alias("distance"))
    return rounded(hy.distance_correlation(d, other))


FISHER_P = f"""q AS (SELECT test_key, stratum, a, b, c, d, greatest(0, (a + c) - (c + d)) AS lo, least(a + b, a + c) AS hi, {lp('a')} AS pa FROM cells),
   fp AS (SELECT test_key, stratum, least(1, list_sum([CASE WHEN {lp('x')} <= pa + 1e-7 THEN exp({lp('x')}) ELSE 0 END for x in range(lo, hi + 1)])) AS p FROM q)"""


@query(
    "win06_bh_adjust",
    """WITH p AS (SELECT l_suppkey % 5 AS fam, l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 1000 + 1) / 1000.0::DOUBLE * (l_orderkey % 90 + 10) / 100.0::DOUBLE AS p FROM lineitem),
       r AS (SELECT *, p * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p) AS raw,
               row_number() OVER (PARTITION BY fam ORDER BY p) AS rk FROM p),
       a AS (SELECT *, least(1, min(raw) OVER (PARTITION BY fam ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r)
       SELECT fam, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p, 9) AS p, round(adj, 9) AS p_adjusted FROM a""",
)
def _(t):
    rows = t.lineitem.select(
        (F.col("l_suppkey") % 5).alias("fam"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ((F.col("l_partkey") % 1000 + 1) / F.lit(1000.0) * (F.col("l_orderkey") % 90 + 10) / F.lit(100.0)).alias("p"),
    )
    return rounded(hy.bh_adjust(rows, ["fam"], "p"))


@query(
    "scl15_significance",
    f"""WITH {FISHER_P} SELECT test_key, stratum, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM fp""",
)
def _(t):
    out = hy.fisher_2x2(t.cells)
    return out.select("test_key", "stratum", fc.significance_stars("p_two_sided").alias("stars"))


# --- replicates -----------------------------------------------------------------------------------

QS = "round(quantile_cont({v}, 0.025), 9) AS ci_low, round(quantile_cont({v}, 0.5), 9) AS median, round(quantile_cont({v}, 0.975), 9) AS ci_high"


@query(
    "agg53_replicate_summary",
    "WITH l AS (SELECT pair, 'ds' AS metric, ds AS v FROM branch_reps UNION ALL SELECT pair, 'dn', dn FROM branch_reps UNION ALL SELECT pair, 'dnds', dnds FROM branch_reps) "
    f"SELECT pair, metric, count(v) AS n_reps, round(avg(v), 9) AS mean, {QS.format(v='v')} FROM l GROUP BY pair, metric",
)
def _(t):
    return rounded(rp.replicate_summaries(t.branch_reps, ["pair"], ["ds", "dn", "dnds"]))


BRANCH = """w AS (SELECT replicate, max(ds) FILTER (WHERE pair = 'A_B') AS ab, max(ds) FILTER (WHERE pair = 'A_C') AS ac, max(ds) FILTER (WHERE pair = 'B_C') AS bc
      FROM branch_reps GROUP BY replicate), br AS (SELECT replicate, (ab + ac - bc) / 2 AS l_a, (ab + bc - ac) / 2 AS l_b, (ac + bc - ab) / 2 AS l_c
      FROM w WHERE ab IS NOT NULL AND ac IS NOT NULL AND bc IS NOT NULL)"""


def branches(t):
    return rp.three_point_branches(t.branch_reps, ["replicate"], "A_B", "A_C", "B_C")


@query(
    "agg54_three_point_branches",
    f"WITH {BRANCH} SELECT replicate, round(l_a, 12) AS l_a, round(l_b, 12) AS l_b, round(l_c, 12) AS l_c FROM br",
)
def _(t):
    return rounded(branches(t), 12)


@query(
    "agg54_lineage_contrast",
    f"""WITH {BRANCH}, l AS (SELECT 'abs_diff' AS metric, l_b - l_a AS v FROM br UNION ALL SELECT 'rel_short', CASE WHEN l_b > 0 THEN 1 - l_a / l_b END FROM br)
        SELECT metric, count(v) AS n_reps, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.5), 6) AS median,
               round(quantile_cont(v, 0.975), 6) AS ci_high FROM l GROUP BY metric""",
)
def _(t):
    return rounded(rp.lineage_contrast(branches(t), ["replicate"]), 6)


def reps(n: int) -> str:
    return f"(SELECT unnest(range(0, {n})) AS rep)"


@query(
    "rep01_bootstrap_keys",
    f"""WITH k AS (SELECT DISTINCT gene FROM gene_set), i AS (SELECT gene, row_number() OVER (ORDER BY md5(gene) || gene) - 1 AS idx, count(*) OVER () AS n FROM k),
        d AS (SELECT r.rep, i.idx AS slot, {duck_hash_int(str(SEED), 'r.rep', 'i.idx')} % n AS pick FROM i CROSS JOIN {reps(20)} r)
        SELECT CAST(d.rep AS INT) AS rep, d.slot, i.gene FROM d JOIN i ON i.idx = d.pick""",
)
def _(t):
    return rp.bootstrap_keys(t.gene_set, "gene", 20, SEED)


TRIO = """tr AS (SELECT b.species, b.child, b.denom, coalesce(n, 0) AS n FROM (SELECT species, child, CAST(sum(bp) AS BIGINT) AS denom FROM callable_bp GROUP BY 1, 2) b
     LEFT JOIN (SELECT child, count(DISTINCT (chrom, pos, ref, alt)) AS n FROM dnm GROUP BY child) m ON m.child = b.child)"""


def per_child(t):
    u = ph.unit_rates(t.dnm, t.callable_bp, ["species", "child"], MUT)
    return u.select("species", "child", F.col("unique_dnms").alias("n_mutations"), F.col("callable_sites").alias("denom"))


BOOT = f"""{TRIO}, i AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY md5(child) || child) - 1 AS idx, count(*) OVER (PARTITION BY species) AS size FROM tr),
    d AS (SELECT species, r.rep, {duck_hash_int(str(SEED), 'species', 'r.rep', 'idx')} % size AS pick FROM i CROSS JOIN {reps(50)} r),
    br AS (SELECT d.species, d.rep, sum(i.n) / (2.0 * sum(i.denom)) AS rate FROM d JOIN i ON i.species = d.species AND i.idx = d.pick GROUP BY 1, 2)"""


@query(
    "rep02_bootstrap_rate",
    f"""WITH {BOOT} SELECT species, count(rate) AS n_reps, round(avg(rate), 12) AS mean, round(quantile_cont(rate, 0.025), 12) AS ci_low,
           round(quantile_cont(rate, 0.5), 12) AS median, round(quantile_cont(rate, 0.975), 12) AS ci_high FROM br GROUP BY species""",
)
def _(t):
    out = rp.bootstrap_rate(per_child(t), "child", ["species"], 50, SEED, ["species"])
    return rounded(rp.replicate_summary(out, ["species"], "rate"), 12)


@query(
    "rep03_bootstrap_hierarchical",
    f"""WITH ppl AS (SELECT species, family, child, CAST(sum(bp) AS BIGINT) AS bp FROM callable_bp GROUP BY ALL),
      fi AS (SELECT species, family, row_number() OVER (PARTITION BY species ORDER BY md5(family) || family) - 1 AS idx, count(*) OVER (PARTITION BY species) AS size
             FROM (SELECT DISTINCT species, family FROM ppl) q),
      fd AS (SELECT f.species, r.rep, f.idx AS fs, {duck_hash_int(str(SEED), 'f.species', 'r.rep', 'f.idx')} % size AS pick FROM fi f CROSS JOIN {reps(10)} r),
      fam AS (SELECT fd.species, rep, fs, family FROM fd JOIN fi ON fi.species = fd.species AND fi.idx = fd.pick),
      ki AS (SELECT *, row_number() OVER (PARTITION BY species, family ORDER BY md5(child) || child) - 1 AS idx, count(*) OVER (PARTITION BY species, family) AS size FROM ppl),
      ch AS (SELECT DISTINCT fam.species, fam.rep, fam.fs, fam.family, {duck_hash_int(str(SEED), "'kid'", 'fam.species', 'fam.rep', 'fam.fs', 'k.idx')} % k.size AS pick
             FROM fam JOIN ki k ON k.species = fam.species AND k.family = fam.family),
      cc AS (SELECT ch.species, rep, fs, ch.family, child, bp FROM ch JOIN ki ON ki.species = ch.species AND ki.family = ch.family AND ki.idx = ch.pick),
      bases_ AS (SELECT species, rep, sum(bp) AS bp FROM cc GROUP BY 1, 2),
      lc AS (SELECT DISTINCT species, family, chrom || ':' || pos || ':' || ref || ':' || alt AS locus, child FROM dnm WHERE phased <> 'F'),
      lph AS (SELECT species, family, chrom || ':' || pos || ':' || ref || ':' || alt AS locus, CASE WHEN bool_or(phased = 'P') AND NOT bool_or(phased = 'M') THEN 'P'
               WHEN bool_or(phased = 'M') AND NOT bool_or(phased = 'P') THEN 'M' ELSE 'U' END AS phase FROM dnm WHERE phased <> 'F' GROUP BY 1, 2, 3),
      ss AS (SELECT species, count(*) FILTER (WHERE phase = 'P') / count(*) FILTER (WHERE phase IN ('P','M')) AS s FROM lph GROUP BY species),
      dr AS (SELECT DISTINCT cc.species, cc.rep, cc.fs, cc.family, lc.locus, lph.phase FROM cc JOIN lc ON lc.species = cc.species AND lc.family = cc.family AND lc.child = cc.child
             JOIN lph ON lph.species = lc.species AND lph.family = lc.family AND lph.locus = lc.locus),
      po AS (SELECT species, rep, fs, count(*) FILTER (WHERE phase = 'P') / nullif(count(*) FILTER (WHERE phase IN ('P','M')), 0) AS s FROM dr GROUP BY 1, 2, 3),
      ct AS (SELECT dr.species, dr.rep, count(*) FILTER (WHERE phase = 'P' OR (phase = 'U' AND {duck_uniform(str(SEED), "'phase'", 'dr.species', 'dr.rep', 'dr.fs', 'dr.locus')} < coalesce(po.s, ss.s))) AS n_p, count(*) AS n
             FROM dr JOIN po ON po.species = dr.species AND po.rep = dr.rep AND po.fs = dr.fs JOIN ss ON ss.species = dr.species GROUP BY 1, 2)
      SELECT b.species, CAST(b.rep AS INT) AS rep, CAST(b.bp AS BIGINT) AS bp, n_p, n - n_p AS n_m, round(n_p / (2.0 * b.bp), 12) AS paternal_rate, round((n - n_p) / (2.0 * b.bp), 12) AS maternal_rate
      FROM bases_ b JOIN ct ON ct.species = b.species AND ct.rep = b.rep""",
)
def _(t):
    rows = t.dnm.filter("phased <> 'F'").withColumn(
        "locus", F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt")
    )
    phase = F.col("phase")
    resolved = rows.groupBy("species", "family", "locus").agg(
        ph.locus_phase().alias("phase"), F.collect_set("child").alias("children")
    ).withColumn("phase", F.when(phase.isin("P", "M"), phase).otherwise("U"))
    loci = resolved.select("species", "family", "locus", F.explode("children").alias("child"), "phase")
    return rounded(rp.bootstrap_hierarchical(loci, t.callable_bp, 10, SEED), 12)


def binomial_sql(src: str, n: str, left: str, right: str, middle: int, out: str) -> str:
    """Rows of ``src`` with ``out``, the binomial quantile of the draw at one split, as SQL."""
    p = f"({left} / ({left} + {right}))"
    return f"""(SELECT s.*, coalesce(q.k, CASE WHEN {right} = 0 THEN {n} ELSE 0 END) AS {out} FROM {src} s LEFT JOIN (
        SELECT test_key, rep, min(k) FILTER (WHERE cdf >= un OR k = last) AS k FROM (
          SELECT test_key, rep, k, un, last, sum(pmf) OVER (PARTITION BY test_key, rep ORDER BY k) AS cdf FROM (
            SELECT test_key, rep, k, {n} AS last, {duck_uniform(str(SEED), 'test_key', 'rep', str(middle))} AS un,
                   exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({p}) + ({n} - k) * ln(1 - {p})) AS pmf
            FROM (SELECT *, unnest(range(0, {n} + 1)) AS k FROM {src} WHERE {n} > 0 AND {left} > 0 AND {right} > 0) x) y) z
        GROUP BY test_key, rep) q ON q.test_key = s.test_key AND q.rep = s.rep)"""


@query(
    "rep04_bootstrap_multinomial",
    f"""WITH s AS (SELECT test_key, r.rep, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d,
                 CAST(a + b + c + d AS BIGINT) AS n FROM (SELECT test_key, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d
                 FROM cells GROUP BY test_key) z CROSS JOIN {reps(5)} r WHERE a + b + c + d > 0),
        t1 AS (SELECT *, n - nl AS nr FROM {binomial_sql('s', 'n', '(a + b)', '(c + d)', 2, 'nl')} x),
        t2 AS (SELECT * FROM {binomial_sql('t1', 'nl', 'a', 'b', 1, 'da')} x),
        t3 AS (SELECT * FROM {binomial_sql('t2', 'nr', 'c', 'd', 3, 'dc')} x),
        o AS (SELECT test_key, rep, n, unnest([{{'k': 'a', 'w': a, 'd': da}}, {{'k': 'b', 'w': b, 'd': nl - da}},
                {{'k': 'c', 'w': c, 'd': dc}}, {{'k': 'd', 'w': d, 'd': nr - dc}}]) AS x FROM t3)
        SELECT test_key, CAST(rep AS INT) AS rep, x.k AS category, x.d AS draws, round(x.d / n, 9) AS share FROM o WHERE x.w > 0""",
)
def _(t):
    sums = t.cells.groupBy("test_key").agg(*[F.sum(x).alias(x) for x in "abcd"])
    long = sums.unpivot(["test_key"], list("abcd"), "category", "n")
    return rounded(rp.bootstrap_multinomial(long, ["test_key"], "category", "n", 5, SEED))


NULL = f"""{units('child')}, pr AS (SELECT species, sum(unique_dnms) / (2.0 * sum(callable_sites)) AS rate FROM u GROUP BY species),
   lam AS (SELECT u.species, u.child, u.callable_sites, r.rep, 2 * u.callable_sites * pr.rate AS lam,
             {duck_uniform(str(SEED), 'u.species', 'r.rep', 'u.child')} AS un FROM u JOIN pr ON pr.species = u.species CROSS JOIN {reps(8)} r),
   pk AS (SELECT species, child, callable_sites, rep, un, k, sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) OVER (PARTITION BY species, child, rep ORDER BY k) AS cdf
          FROM (SELECT *, unnest(range(0, CAST(lam + 12 * sqrt(lam) + 40 AS BIGINT))) AS k FROM lam) q),
   dw AS (SELECT species, child, rep, any_value(callable_sites) AS c, min(k) FILTER (WHERE cdf >= un) AS k FROM pk GROUP BY 1, 2, 3),
   nl AS (SELECT species, CAST(rep AS INT) AS rep, var_pop(k / (2.0 * c)) AS variance, stddev_pop(k / (2.0 * c)) / avg(k / (2.0 * c)) AS cv FROM dw GROUP BY 1, 2)"""


def child_units(t):
    return ph.unit_rates(t.dnm, t.callable_bp, ["species", "child"], MUT)


def child_null(t):
    return rp.poisson_null(child_units(t), ["species"], "child", 8, SEED)


@query(
    "rep05_poisson_null",
    f"WITH {NULL} SELECT species, rep, round(variance, 12) AS variance, round(cv, 9) AS cv FROM nl",
)
def _(t):
    out = child_null(t)
    return out.select("species", "rep", F.round("variance", 12).alias("variance"), F.round("cv", 9).alias("cv"))


@query(
    "tst11_empirical_p",
    f"""WITH {NULL}, ob AS (SELECT species, stddev_pop(rate) / avg(rate) AS obs FROM u GROUP BY species)
        SELECT nl.species, round(obs, 9) AS obs, count(*) AS n_sim, round(avg(CASE WHEN cv >= obs THEN 1.0 ELSE 0.0 END), 9) AS p_upper,
          round(avg(CASE WHEN cv <= obs THEN 1.0 ELSE 0.0 END), 9) AS p_lower, round(avg(cv), 9) AS sim_mean, round(stddev_pop(cv), 9) AS sim_sd,
          round(2 * least(avg(CASE WHEN cv >= obs THEN 1.0 ELSE 0.0 END), avg(CASE WHEN cv <= obs THEN 1.0 ELSE 0.0 END)), 9) AS p_two_tailed,
          round((obs - avg(cv)) / stddev_pop(cv), 6) AS z FROM nl JOIN ob ON ob.species = nl.species GROUP BY nl.species, obs""",
)
def _(t):
    obs = ph.rate_dispersion(child_units(t), ["species"]).select("species", F.col("cv").alias("obs"))
    out = hy.empirical_p(child_null(t), obs, ["species"], "cv", "obs")
    return p6(out, "z")


PAIRS = "pairs_ AS (SELECT a.species AS first, b.species AS second FROM species_dim a JOIN species_dim b ON a.sociality = 'subsocial' AND b.sociality = 'social' AND b.leaf_order = a.leaf_order + 1)"


def sister_pairs(t):
    d = t.species_dim
    a = d.filter("sociality = 'subsocial'").select(F.col("species").alias("first"), (F.col("leaf_order") + 1).alias("next"))
    b = d.filter("sociality = 'social'").select(F.col("species").alias("second"), F.col("leaf_order").alias("next"))
    return a.join(b, "next").select("first", "second")


@query(
    "rep05_pair_contrast",
    f"""WITH {NULL}, {PAIRS}, ob AS (SELECT species, stddev_pop(rate) / avg(rate) AS cv FROM u GROUP BY species),
        o AS (SELECT first, second, x.cv - y.cv AS delta FROM pairs_ JOIN ob x ON x.species = first JOIN ob y ON y.species = second)
        SELECT o.first, o.second, round(delta, 9) AS delta, round(avg(CASE WHEN x.cv - y.cv >= delta THEN 1.0 ELSE 0.0 END), 9) AS p_upper, count(*) AS n_sim
        FROM o JOIN nl x ON x.species = o.first JOIN nl y ON y.species = o.second AND y.rep = x.rep GROUP BY o.first, o.second, delta""",
)
def _(t):
    obs = ph.rate_dispersion(child_units(t), ["species"])
    return rounded(rp.pair_contrast(child_null(t), obs, sister_pairs(t)))


@query(
    "rep05_group_contrast",
    f"""WITH {NULL}, ob AS (SELECT species, stddev_pop(rate) / avg(rate) AS cv FROM u GROUP BY species),
        o AS (SELECT avg(cv) FILTER (WHERE sociality = 'subsocial') - avg(cv) FILTER (WHERE sociality = 'social') AS delta FROM ob JOIN species_dim USING (species)),
        s AS (SELECT rep, avg(cv) FILTER (WHERE sociality = 'subsocial') - avg(cv) FILTER (WHERE sociality = 'social') AS sim FROM nl JOIN species_dim USING (species) GROUP BY rep)
        SELECT round(delta, 9) AS delta, round(avg(CASE WHEN sim >= delta THEN 1.0 ELSE 0.0 END), 9) AS p_upper, count(*) AS n_sim FROM s, o GROUP BY delta""",
)
def _(t):
    obs = ph.rate_dispersion(child_units(t), ["species"]).select("species", "cv")
    return rounded(rp.group_contrast(child_null(t), obs, t.species_dim))


@query(
    "rep05_combined_sign",
    f"""WITH {NULL}, {PAIRS} SELECT round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS p_all_positive FROM (
          SELECT x.rep, bool_and(x.cv > y.cv) AS ok FROM pairs_ JOIN nl x ON x.species = first JOIN nl y ON y.species = second AND y.rep = x.rep GROUP BY x.rep) z""",
)
def _(t):
    return rounded(rp.combined_sign(child_null(t), sister_pairs(t)))


@query(
    "rep06_uniform_interval_null",
    f"""WITH {islands('ivals', 0, 'chrom')}, off_ AS (SELECT chrom, start, sum(stop - start) OVER (ORDER BY chrom, start) AS hi, stop - start AS len FROM x),
        n AS (SELECT count(*) AS n FROM orders), tot AS (SELECT CAST(max(hi) AS BIGINT) AS total FROM off_),
        s AS (SELECT rep, slot, {duck_hash_int(str(SEED), 'rep', 'slot')} % total AS o FROM (SELECT unnest(range(0, n)) AS slot, total FROM n, tot) q CROSS JOIN {reps(3)} r),
        p AS (SELECT s.rep, f.chrom, f.start + s.o - (f.hi - f.len) AS pos FROM s ASOF JOIN (SELECT *, CAST(hi - len AS BIGINT) AS lo FROM off_) f ON s.o >= f.lo),
        g AS (SELECT rep, pos - lag(pos) OVER w AS l, lead(pos) OVER w - pos AS r FROM p WINDOW w AS (PARTITION BY rep, chrom ORDER BY pos))
        SELECT CAST(rep AS INT) AS rep, round(avg(least(l, r)), 6) AS mean_distance, count(*) AS n_points FROM g WHERE l IS NOT NULL OR r IS NOT NULL GROUP BY rep""",
)
def _(t):
    union = spans.merge_spans(t.ivals, ["chrom"], 0, end="stop").drop("covered")
    n = t.orders.agg(F.count("*").alias("n"))
    return rounded(rp.uniform_interval_null(union, n, 3, SEED, end="stop"), 6)
