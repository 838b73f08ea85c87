"""Tests on keyed contingency and summary tables.

The statistic is a Spark aggregate for any number of keys.  Only the closing p-value is a
vectorised function on the aggregated rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.calls import log2_odds
from ..functions.special import chi2_sf, fisher_p, normal_two_sided, three_way_g2
from ..plans.cut import cut_lineage
from ..plans.gram import pair_sums
from ..plans.lookup import lookup_join
from ..plans.running import probability_bucket, running, signed_bucket


def chi2_gof(df: DataFrame, keys: list[str], obs: str, exp: str, p_values: bool = True) -> DataFrame:
    """Goodness of fit over the cells with a positive expectation."""
    o, e = F.col(obs), F.col(exp)
    out = (
        df.filter(e > 0)
        .groupBy(*keys)
        .agg(F.sum((o - e) * (o - e) / e).alias("chi2"), (F.count("*") - 1).alias("dof"))
    )
    return out.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof"))) if p_values else out


def chi2_contingency(df: DataFrame, keys: list[str], row: str, col: str, n: str, p_values: bool = True) -> DataFrame:
    """r x c test per key; Yates' correction only with one degree of freedom.

    The cells are rebuilt from the two margins of a key, so absent cells count as 0.
    """
    cells = df.groupBy(*keys, row, col).agg(F.sum(n).alias("__n"))
    rows = cells.groupBy(*keys, row).agg(F.sum("__n").alias("__r")).filter("__r > 0")
    cols = cells.groupBy(*keys, col).agg(F.sum("__n").alias("__c")).filter("__c > 0")
    shape = rows.groupBy(*keys).agg(F.sum("__r").alias("__t"), F.count("*").alias("__nr")).join(
        cols.groupBy(*keys).agg(F.count("*").alias("__nc")), keys
    )
    table = rows.join(cols, keys).join(cells, [*keys, row, col], "left").join(shape, keys)
    dof = (F.col("__nr") - 1) * (F.col("__nc") - 1)
    e = F.col("__r") * F.col("__c") / F.col("__t")
    gap = F.abs(F.coalesce("__n", F.lit(0)) - e)
    used = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = table.groupBy(*keys, dof.alias("dof")).agg(F.sum(used * used / e).alias("chi2"))
    return out.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof"))) if p_values else out


def fisher_2x2(df: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> DataFrame:
    """Odds ratio, two-sided and one-sided (greater) exact p-values per row."""
    cols = [F.col(x) for x in (a, b, c, d)]
    denom = F.col(b).cast("double") * F.col(c)
    empty = (F.col(a) + F.col(b) == 0) | (F.col(c) + F.col(d) == 0)
    return (
        df.withColumn("odds_ratio", F.when(denom != 0, F.col(a).cast("double") * F.col(d) / denom))
        .withColumn("__p", fisher_p(*cols))
        .withColumn("p_two_sided", F.when(~empty, F.col("__p.two_sided")))
        .withColumn("p_greater", F.when(~empty, F.col("__p.greater")))
        .drop("__p")
    )


def category_tests(table: DataFrame, keys: list[str], category: str, first: str, second: str) -> DataFrame:
    """Each category against the rest between two count columns: shares, odds ratio, exact
    p-value and its Benjamini-Hochberg adjustment within ``keys``."""
    totals = table.groupBy(*keys).agg(F.sum(first).alias("__t1"), F.sum(second).alias("__t2"))
    rows = table.join(totals, keys) if keys else table.join(F.broadcast(totals))
    cells = rows.select(
        *keys,
        category,
        F.col(first).alias("a"),
        (F.col("__t1") - F.col(first)).alias("b"),
        F.col(second).alias("c"),
        (F.col("__t2") - F.col(second)).alias("d"),
    )
    share = lambda x, y: F.when(F.col(x) + F.col(y) > 0, F.col(x) / (F.col(x) + F.col(y))).otherwise(F.lit(0.0))
    tested = (
        fisher_2x2(cells)
        .withColumn("share_first", share("a", "b"))
        .withColumn("share_second", share("c", "d"))
        .withColumn("log2_or", log2_odds("a", "b", "c", "d"))
    )
    return bh_adjust(tested, keys, "p_two_sided").withColumn(
        "significant", F.coalesce(F.col("p_adjusted") < 0.05, F.lit(False))
    )


def _margins(a="a", b="b", c="c", d="d"):
    a, b, c, d = (F.col(x).cast("double") for x in (a, b, c, d))
    return a, b, c, d, a + b, c + d, a + c, b + d, a + b + c + d


def cmh(strata: DataFrame, keys: list[str], p_values: bool = True) -> DataFrame:
    """Cochran-Mantel-Haenszel with continuity correction and the common odds ratio.

    ``strata``: keys and cells a, b, c, d, one row per stratum.
    """
    a, b, c, d, n1, n2, m1, m2, n = _margins()
    v = F.when(n > 1, n1 * n2 * m1 * m2 / (n * n * (n - 1)))
    sums = strata.filter(n > 0).groupBy(*keys).agg(
        F.sum(a).alias("__a"),
        F.sum(n1 * m1 / n).alias("__e"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("__v"),
        F.sum(a * d / n).alias("__r"),
        F.sum(b * c / n).alias("__s"),
    )
    ok = F.col("__v") > 0
    gap = F.abs(F.col("__a") - F.col("__e")) - 0.5
    out = sums.select(
        *keys,
        F.when(ok, gap * gap / F.col("__v")).alias("cmh_chi2"),
        F.when(ok & (F.col("__s") > 0), F.col("__r") / F.col("__s")).alias("or_mh"),
    )
    return out.withColumn("cmh_p", chi2_sf(F.col("cmh_chi2"), F.lit(1))) if p_values else out


def expected_corner(odds: Column, n1: Column, n2: Column, m1: Column, n: Column) -> Column:
    """Upper-left cell of a 2x2 table with the given margins and odds ratio."""
    qa = odds - 1.0
    qb = -(odds * (n1 + m1) + (n2 - m1))
    qc = odds * n1 * m1
    root = F.sqrt(F.greatest(qb * qb - 4 * qa * qc, F.lit(0.0)))
    low, high = (-qb - root) / (2 * qa), (-qb + root) / (2 * qa)
    inside = (low >= F.greatest(F.lit(0.0), m1 - n2)) & (low <= F.least(n1, m1))
    return F.when(F.abs(qa) < 1e-12, n1 * m1 / n).when(inside, low).otherwise(high)


def breslow_day(strata: DataFrame, keys: list[str], p_values: bool = True) -> DataFrame:
    """Homogeneity of odds ratios across strata, Tarone corrected.

    Strata whose expected table has an empty cell have no variance and are left out.
    """
    a, b, c, d, n1, n2, m1, m2, n = _margins()
    common = strata.filter(n > 0).groupBy(*keys).agg(
        F.sum(a * d / n).alias("__r"), F.sum(b * c / n).alias("__s")
    )
    common = common.filter("__r > 0 AND __s > 0").withColumn("__or", F.col("__r") / F.col("__s"))
    rows = strata.filter(n > 0).join(common, keys).withColumn(
        "__e", expected_corner(F.col("__or"), n1, n2, m1, n)
    )
    e = F.col("__e")
    cells = [e, n1 - e, m1 - e, n2 - m1 + e]
    usable = cells[0] > 0
    for x in cells[1:]:
        usable = usable & (x > 0)
    var = F.when(usable, 1.0 / sum((1.0 / x for x in cells[1:]), 1.0 / e))
    sums = rows.withColumn("__v", var).groupBy(*keys, "__or").agg(
        F.sum((a - e) * (a - e) / F.col("__v")).alias("__x"),
        F.sum(F.when(F.col("__v").isNotNull(), a - e)).alias("__d"),
        F.sum("__v").alias("__vs"),
        (F.count("__v") - 1).alias("dof"),
    )
    out = sums.select(
        *keys,
        F.col("__or").alias("or_mh"),
        (F.col("__x") - F.col("__d") * F.col("__d") / F.col("__vs")).alias("bd_chi2"),
        "dof",
    )
    return out.withColumn("bd_p", chi2_sf(F.col("bd_chi2"), F.col("dof"))) if p_values else out


def poisson_interaction(df: DataFrame, p_values: bool = True) -> DataFrame:
    """Likelihood ratio test of group x level in a 2x2 table of Poisson rates.

    Columns y11, y12, y21, y22 and exposures e11..e22.  The no-interaction fit keeps the
    margins of the counts and the odds ratio of the exposures, so it is the root of a
    quadratic.
    """
    y = {k: F.col(f"y{k}").cast("double") for k in ("11", "12", "21", "22")}
    e = {k: F.col(f"e{k}").cast("double") for k in ("11", "12", "21", "22")}
    n1, n2, m1 = y["11"] + y["12"], y["21"] + y["22"], y["11"] + y["21"]
    total = n1 + n2
    odds = e["11"] * e["22"] / (e["12"] * e["21"])
    fit = expected_corner(odds, n1, n2, m1, total)
    corner = F.col("__f")
    means = {"11": corner, "12": n1 - corner, "21": m1 - corner, "22": n2 - m1 + corner}
    term = lambda k: F.when((y[k] > 0) & (means[k] > 0), y[k] * F.log(y[k] / means[k])).otherwise(F.lit(0.0))
    positive = (e["11"] > 0) & (e["12"] > 0) & (e["21"] > 0) & (e["22"] > 0) & (total > 0)
    g2 = 2 * (term("11") + term("12") + term("21") + term("22"))
    out = df.withColumn("__f", F.when(positive, fit)).withColumn(
        "lrt_chi2", F.when(positive, F.greatest(g2, F.lit(0.0)))
    )
    if p_values:
        out = out.withColumn("p_value", chi2_sf(F.col("lrt_chi2"), F.lit(1)))
    return out.drop("__f")


def loglinear_3way(df: DataFrame, keys: list[str], group: str, level: str, category: str, n: str, groups: tuple, levels: tuple, categories: list[str], p_values: bool = True) -> DataFrame:
    """G-squared of group x level x category without the three-way term, per key.

    Cells are summed in Spark into four arrays over the fixed category list; the fit runs on
    those arrays, one row per key.
    """
    pick = lambda g, lv, c: F.coalesce(
        F.sum(F.when((F.col(group) == g) & (F.col(level) == lv) & (F.col(category) == c), F.col(n))), F.lit(0)
    ).cast("double")
    cells = df.groupBy(*keys, group, level, category).agg(F.sum(n).alias(n))
    tables = cells.groupBy(*keys).agg(
        *[
            F.array(*[pick(g, lv, c) for c in categories]).alias(f"__{i}{j}")
            for i, g in enumerate(groups)
            for j, lv in enumerate(levels)
        ]
    )
    out = tables.select(*keys, three_way_g2(*[F.col(f"__{i}{j}") for i in (0, 1) for j in (0, 1)]).alias("g2"))
    out = out.withColumn("dof", F.lit(len(categories) - 1))
    return out.withColumn("p_value", chi2_sf(F.col("g2"), F.col("dof"))) if p_values else out


def mann_whitney(df: DataFrame, keys: list[str], value: str, first: Column, p_values: bool = True) -> DataFrame:
    """Two-sided rank-sum test of the rows where ``first`` holds against the others.

    Average ranks come from running counts over distinct values; normal approximation with
    tie and continuity correction.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("__n"), F.count_if(first).alias("__n1")
    )
    run = running(hist, keys, value, signed_bucket(value), {"__before": ("sum", "__n")}, inclusive=False)
    t = F.col("__n").cast("double")
    rank = F.col("__before") + (t + 1) / 2
    sums = run.groupBy(*keys).agg(
        F.sum(rank * F.col("__n1")).alias("__r1"),
        F.sum("__n1").alias("n1"),
        F.sum("__n").alias("__total"),
        F.sum(t * t * t - t).alias("__ties"),
    )
    n1, n = F.col("n1"), F.col("__total")
    n2 = n - n1
    u1 = F.col("__r1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("__ties") / (n * (n - 1))))
    z = (F.greatest(F.col("u1"), n1 * n2 - F.col("u1")) - mu - 0.5) / sd
    out = sums.withColumn("u1", u1).withColumn("n2", n2).withColumn("z", F.when(sd > 0, z))
    if p_values:
        out = out.withColumn("p_value", F.least(F.lit(1.0), F.when(F.col("z") > 0, normal_two_sided(F.col("z"))).otherwise(F.lit(1.0))))
    return out.select(*keys, "n1", "n2", "u1", "z", *(["p_value"] if p_values else []))


def bh_adjust(df: DataFrame, keys: list[str], p: str, out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within ``keys``.

    Works on distinct p-values: a running count gives the rank, a running minimum from the
    largest p gives the adjustment, and the result is joined back on the p-value.
    """
    hist = df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("__n"))
    ranked = running(hist, keys, p, probability_bucket(p), {"__rank": ("sum", "__n")})
    total = hist.groupBy(*keys).agg(F.sum("__n").alias("__m"))
    raw = (ranked.join(total, keys) if keys else ranked.join(F.broadcast(total))).withColumn(
        "__raw", F.col(p) * F.col("__m") / F.col("__rank")
    )
    adjusted = running(raw, keys, p, probability_bucket(p), {"__adj": ("min", "__raw")}, reverse=True)
    table = adjusted.select(*keys, p, F.least(F.lit(1.0), F.col("__adj")).alias(out))
    return df.join(table, [*keys, p], "left")


def empirical_p(null: DataFrame, observed: DataFrame, keys: list[str], sim: str, obs: str, plus_one: bool = False) -> DataFrame:
    """Upper, lower and two-tailed empirical p-values, null mean and spread, and z.

    ``plus_one`` counts the observation itself: (hits + 1) / (n + 1).
    """
    joined = null.join(observed, keys) if keys else null.join(F.broadcast(observed))
    s, o = F.col(sim), F.col(obs)
    add = 1 if plus_one else 0
    stats = joined.filter(s.isNotNull()).groupBy(*keys, obs).agg(
        F.count("*").alias("n_sim"),
        ((F.count_if(s >= o) + add) / (F.count("*") + add)).alias("p_upper"),
        ((F.count_if(s <= o) + add) / (F.count("*") + add)).alias("p_lower"),
        F.avg(s).alias("sim_mean"),
        F.stddev_pop(s).alias("sim_sd"),
    )
    return stats.withColumn(
        "p_two_tailed", 2 * F.least("p_upper", "p_lower")
    ).withColumn("z", F.when(F.col("sim_sd") > 0, (o - F.col("sim_mean")) / F.col("sim_sd")))


def cosine_distance_pairs(vectors: DataFrame, entity: str, dim: str, value: str, most: float | None = None) -> DataFrame:
    """Cosine distance of all unordered pairs of entities from long (entity, dim, value) rows.

    A zero vector has distance 0 to everything.  With ``most`` only pairs of non-negative, non-zero
    vectors at a distance of at most ``most`` are returned: vectors are divided by their norms, so
    that a pair that cannot be near is dropped inside its task.
    """
    def dot(m):
        v = np.nan_to_num(m)
        return v.T @ v

    norms = vectors.groupBy(F.col(entity).cast("string").alias("__e")).agg(
        F.sqrt(F.sum(F.col(value) * F.col(value))).alias("__norm")
    )
    bucket = F.pmod(F.xxhash64(dim), F.lit(64))
    if most is not None:
        unit = lookup_join(
            vectors.withColumn("__e", F.col(entity).cast("string")), cut_lineage(norms.filter("__norm > 0")), ["__e"]
        )
        near = pair_sums(
            unit, entity, F.col(dim), bucket, F.col(value) / F.col("__norm"), {"dot": dot}, cutoff=("dot", 1.0 - most)
        )
        return near.select("a", "b", (1.0 - F.col("dot")).alias("distance"))
    sums = pair_sums(vectors, entity, F.col(dim), bucket, F.col(value), {"dot": dot})
    na = norms.select(F.col("__e").alias("a"), F.col("__norm").alias("__na"))
    nb = norms.select(F.col("__e").alias("b"), F.col("__norm").alias("__nb"))
    scale = F.col("__na") * F.col("__nb")
    return (
        sums.join(na, "a")
        .join(nb, "b")
        .select("a", "b", F.when(scale > 0, 1.0 - F.col("dot") / scale).otherwise(F.lit(0.0)).alias("distance"))
    )


def distance_correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Correlation of two distances over the same unordered pairs (a, b)."""
    return left.join(right.withColumnRenamed("distance", "__other"), ["a", "b"]).agg(
        F.corr("distance", "__other").alias("r"), F.count("*").alias("n_pairs")
    )


def tree_order(paths: DataFrame) -> DataFrame:
    """(leaf, place, depth, shared): leaves in the order of a walk through the tree.

    ``paths``: leaf, ancestor, depth (0 at the root; a leaf may be its own last ancestor).  Leaves
    of one subtree have neighbouring places, so a node's leaves are an interval (an Euler tour seen
    at the leaves); ``shared`` is the depth of the last ancestor shared with the next leaf, NULL at
    the last one.  The rows are one per leaf.
    """
    lines = paths.groupBy("leaf").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("line"),
        F.max("depth").alias("depth"),
    )
    walk = W.orderBy("line", "leaf")
    after = F.lead("line").over(walk)
    same = F.array_position(F.zip_with("line", after, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), 0)
    shared = F.when(after.isNotNull(), F.when(same > 0, same - 1).otherwise(F.size("line")) - 1)
    return lines.select(
        "leaf", (F.row_number().over(walk) - 1).alias("place"), "depth", shared.cast("int").alias("shared")
    )


def tree_intervals(paths: DataFrame, order: DataFrame) -> DataFrame:
    """(ancestor, first, last): the places of the leaves below each node."""
    return (
        paths.join(order.select("leaf", "place"), "leaf")
        .groupBy("ancestor")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
    )


def least_tables(order: DataFrame) -> DataFrame:
    """(level, at, least): the least ``shared`` of places at .. at + 2^level - 1, for all levels.

    n log n rows for n leaves, from one vectorised pass over the leaves in order.
    """

    def build(batches):
        rows = pd.concat(list(batches))
        values = rows.sort_values("place")["shared"].dropna().to_numpy(np.int64)
        level = 0
        while len(values):
            yield pd.DataFrame({"level": level, "at": np.arange(len(values)), "least": values})
            step = 1 << level
            values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
            level += 1

    one = order.select("place", F.col("shared").cast("double")).coalesce(1)
    return one.mapInPandas(build, "level int, at int, least int")


def tree_distance(paths: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Edges between leaves: the depths of both less twice the depth of their last common ancestor.

    The last common ancestor of two leaves has the least shared depth between their places, which
    two entries of ``least_tables`` give.  ``pairs`` (a, b) names the pairs wanted; without it all
    unordered pairs a < b are answered.  Pairs of leaves of different trees are left out.
    """
    order = cut_lineage(tree_order(paths))
    table = cut_lineage(least_tables(order))
    if pairs is None:
        # Each leaf meets the leaves behind it in the walk.
        ends = order.agg(F.max("place").alias("end"))
        first = order.join(F.broadcast(ends)).filter("place < end")  # one row
        found = first.select(F.col("leaf").alias("x"), F.col("depth").alias("dx"), F.col("place").alias("i"),
                             F.explode(F.sequence(F.col("place") + 1, F.col("end"))).alias("j"))
        other = order.select(F.col("place").alias("j"), F.col("leaf").alias("y"), F.col("depth").alias("dy"))
        found = lookup_join(found, other, ["j"]).select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dx", "dy", "i", "j"
        )
    else:
        side = lambda leaf, d, p: order.select(F.col("leaf").alias(leaf), F.col("depth").alias(d), F.col("place").alias(p))
        found = lookup_join(lookup_join(pairs.select("a", "b").filter("a <> b"), side("a", "dx", "p"), ["a"]), side("b", "dy", "q"), ["b"])
        found = found.select("a", "b", "dx", "dy", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
    level = F.floor(F.log2(F.col("j") - F.col("i") + F.lit(0.5))).cast("int")
    ranged = found.withColumn("level", F.greatest(level, F.lit(0)))
    ranged = ranged.withColumn("k", (F.col("j") - F.call_function("shiftleft", F.lit(1), F.col("level"))).cast("int"))
    left = table.select("level", F.col("at").alias("i"), F.col("least").alias("__l"))
    right = table.select("level", F.col("at").alias("k"), F.col("least").alias("__r"))
    met = lookup_join(lookup_join(ranged, left, ["level", "i"]), right, ["level", "k"])
    shared = F.least("__l", "__r")
    return met.filter(shared >= 0).select(
        "a", "b", (F.col("dx") + F.col("dy") - 2 * shared).cast("double").alias("distance")
    )
