"""Sweeps, joins and replicates against brute force, with bins small enough to cross."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.plans import spans
from kindred.plans.draws import hash_int
from kindred.plans.gram import pair_sums
from kindred.plans.lookup import lookup_join
from kindred.plans.running import (
    dense_index,
    exact_quantiles,
    neighbours,
    position_bucket,
    probability_bucket,
    running,
    signed_bucket,
)
from kindred.plans.spine import dense_counts


def skewed_points(n=600, seed=1, span=4000):
    """One key holds more than a third of all rows."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(4)}", rnd.randrange(1, span)) for _ in range(n)]


def union(rows, gap):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0, 3, 70, 500])
@pytest.mark.parametrize("width", [16, 100, 65536])
def test_merge_spans(spark, gap, width):
    rnd = random.Random(gap + width)
    rows = [(k, s, s + rnd.choice([0, 1, 5, 40, 333])) for k, s in skewed_points(200)]
    got = spans.merge_spans(spark.createDataFrame(rows, "chrom string, start bigint, end bigint"), ["chrom"], gap, width=width)
    got = sorted((r.chrom, r.start, r.end, r.covered) for r in got.collect())
    want = []
    for k in {r[0] for r in rows}:
        mine = [(s, e) for c, s, e in rows if c == k and e > s]
        for s, e in union(mine, gap):
            want.append((k, s, e, sum(y - x for x, y in mine if x >= s and y <= e)))
    assert got == sorted(want)


@pytest.mark.parametrize("gap", [0, 1, 2, 100])
def test_points_to_spans(spark, gap):
    rows = skewed_points(150, 3, 1500)
    got = spans.points_to_spans(spark.createDataFrame(rows, "chrom string, pos bigint"), ["chrom"], "pos", gap, width=64)
    got = sorted((r.chrom, r.start, r.end) for r in got.collect())
    want = []
    for k in {r[0] for r in rows}:
        cur = None
        for p in sorted({p for c, p in rows if c == k}):
            if cur and p - cur[1] <= gap:
                cur[1] = p
            else:
                cur = [p - 1, p]
                want.append((k, cur))
    assert got == sorted((k, a, b) for k, (a, b) in want)


def test_merge_touching_nested_and_gap_edges(spark):
    rows = [("c", 0, 10), ("c", 10, 20), ("c", 12, 15), ("c", 120, 130), ("c", 231, 240)]
    df = spark.createDataFrame(rows, "chrom string, start bigint, end bigint")
    at = lambda gap: sorted((r.start, r.end) for r in spans.merge_spans(df, ["chrom"], gap, width=8).collect())
    assert at(0) == [(0, 20), (120, 130), (231, 240)]
    assert at(100) == [(0, 130), (231, 240)]
    assert at(101) == [(0, 240)]


@pytest.mark.parametrize("distance", [1, 7, 150])
def test_crowded_and_near_other(spark, distance):
    rows = skewed_points(160, 5, 9000)
    df = spark.createDataFrame(rows, "chrom string, pos bigint")
    got = {(r.chrom, r.pos) for r in spans.crowded_positions(df, ["chrom"], "pos", distance, width=4).collect()}
    assert got == {a for a in rows if any(a[0] == b[0] and 0 < abs(a[1] - b[1]) <= distance for b in rows)}
    q, o = rows[:80], rows[80:]
    near = spans.near_other(
        spark.createDataFrame(q, "chrom string, pos bigint"), spark.createDataFrame(o, "chrom string, pos bigint"),
        ["chrom"], "pos", distance, width=4,
    )
    got = {(r.chrom, r.pos) for r in near.collect()}
    assert got == {a for a in q if any(a[0] == b[0] and 0 < abs(a[1] - b[1]) <= distance for b in o)}


def test_distance_150_and_151(spark):
    rows = [("c", 100), ("c", 250), ("c", 1000), ("c", 1151), ("d", 1001), ("c", 5000), ("c", 5000)]
    kept = spans.drop_crowded(spark.createDataFrame(rows, "chrom string, pos bigint"), ["chrom"], "pos", 150)
    assert sorted((r.chrom, r.pos) for r in kept.collect()) == [
        ("c", 1000), ("c", 1151), ("c", 5000), ("c", 5000), ("d", 1001),
    ]


@pytest.mark.parametrize("salts", [1, 3])
@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_point_in_span(spark, how, salts):
    rnd = random.Random(9)
    points = [(k, p, i) for i, (k, p) in enumerate(skewed_points(120, 8))]
    sp = [(k, s, s + rnd.choice([0, 1, 30, 900]), i) for i, (k, s) in enumerate(skewed_points(60, 4))]
    out = spans.point_in_span(
        spark.createDataFrame(points, "chrom string, pos bigint, i int"),
        spark.createDataFrame(sp, "chrom string, start bigint, end bigint, j int"),
        ["chrom"], "pos", width=50, how=how, salts=salts,
    )
    hits = [(p[2], s[3]) for p in points for s in sp if p[0] == s[0] and s[1] <= p[1] < s[2]]
    if how == "inner":
        assert sorted((r.i, r.j) for r in out.collect()) == sorted(hits)
    else:
        inside = {i for i, _ in hits}
        want = inside if how == "left_semi" else {p[2] for p in points} - inside
        assert {r.i for r in out.collect()} == want


def test_running_and_neighbours(spark):
    rows = sorted(set(skewed_points(200, 2, 900)))
    df = spark.createDataFrame([(k, p, p % 7 + 1) for k, p in rows], "k string, pos bigint, v bigint")
    got = running(df, ["k"], "pos", position_bucket("pos", 32), {"s": ("sum", "v"), "m": ("max", "v")})
    for r in got.collect():
        before = [p % 7 + 1 for k, p in rows if k == r.k and p <= r.pos]
        assert (r.s, r.m) == (sum(before), max(before))
    for r in neighbours(df, ["k"], "pos", 32).collect():
        mine = [p for k, p in rows if k == r.k]
        assert r.prev_pos == max((p for p in mine if p < r.pos), default=None)
        assert r.next_pos == min((p for p in mine if p > r.pos), default=None)


def test_neighbours_read_and_deal_their_points_once(spark, tmp_path):
    import re

    path = str(tmp_path / "points")
    spark.range(500).selectExpr("id % 3 AS k", "id * 7 AS pos").write.parquet(path)
    plan = neighbours(spark.read.parquet(path), ["k"], "pos", 64)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(k#\d+L, __bucket#\d+L, \d+\), REPARTITION_BY_COL", plan)
    got = neighbours(spark.read.parquet(path), ["k"], "pos", 64)
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert dealt and "ReusedExchange" in final and final.count("FileScan parquet") == 1


def test_buckets_are_monotone(spark):
    values = sorted([0.0, 1e-300, 1e-12, 0.1, 0.25, 0.5, 0.9999, 1.0] + list(np.random.default_rng(1).random(200)))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r.b for r in df.select("v", probability_bucket("v").alias("b")).orderBy("v").collect()]
    assert got == sorted(got)
    signed = spark.createDataFrame([(float(v),) for v in [-5e9, -1.0, -1e-9, 0.0, 1e-9, 1.0, 3.0, 5e9]], "v double")
    got = [r.b for r in signed.select("v", signed_bucket("v").alias("b")).orderBy("v").collect()]
    assert got == sorted(got)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if rng.random() < 0.6 else "k", float(x)) for x in np.round(rng.normal(0, 50, 400), 1)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.025, "b": 0.5, "c": 0.975})
    for r in got.collect():
        v = [x for k, x in rows if k == r.k]
        assert np.allclose([r.a, r.b, r.c], np.quantile(v, [0.025, 0.5, 0.975]))


def test_dense_index_is_dense_and_stable(spark):
    df = spark.createDataFrame([(f"g{i % 50}",) for i in range(200)], "gene string")
    a = {r.gene: r.idx for r in dense_index(df, "gene").collect()}
    b = {r.gene: r.idx for r in dense_index(df.repartition(7), "gene").collect()}
    assert a == b and sorted(a.values()) == list(range(50))


def test_dense_counts_keeps_empty_strata(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", None, 5), ("b", None, 1)], "k string, c string, n bigint")
    got = {(r.k, r.c): (r.n, r.total) for r in dense_counts(df, ["k"], "c", "n", ["x", "y", "all"], overall="all").collect()}
    assert got == {
        ("a", "x"): (2, 2), ("a", "y"): (0, 2), ("a", "all"): (2, 2),
        ("b", "x"): (0, 0), ("b", "y"): (0, 0), ("b", "all"): (0, 0),
    }


@pytest.mark.parametrize("max_rows", [1000, 2])
def test_lookup_join_both_ways(spark, max_rows):
    facts = spark.createDataFrame([("hot", i) for i in range(50)] + [("z", 1), ("none", 2)], "k string, v int")
    dim = spark.createDataFrame([("hot", 1), ("z", 2), ("y", 3)], "k string, w int")
    got = lookup_join(facts, dim, ["k"], "left", max_rows=max_rows).collect()
    assert sorted((r.k, r.v, r.w or 0) for r in got) == sorted(
        [("hot", i, 1) for i in range(50)] + [("z", 1, 2), ("none", 2, 0)]
    )


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_pair_sums_do_not_depend_on_blocks(spark, blocks):
    rng = np.random.default_rng(4)
    m = rng.integers(0, 3, (40, 9)).astype(float)
    m[rng.random(m.shape) < 0.2] = np.nan
    rows = [(f"e{j}", i, float(m[i, j])) for i in range(40) for j in range(9) if not np.isnan(m[i, j])]
    df = spark.createDataFrame(rows, "e string, i int, v double")
    both = lambda x: (~np.isnan(x)).astype(float).T @ (~np.isnan(x)).astype(float)
    dot = lambda x: np.nan_to_num(x).T @ np.nan_to_num(x)
    got = pair_sums(df, "e", F.col("i"), F.floor(F.col("i") / 7), F.col("v"), {"n": both, "d": dot}, blocks)
    got = {(r.a, r.b): (r.n, r.d) for r in got.collect()}
    want = {(f"e{a}", f"e{b}"): (both(m)[a, b], dot(m)[a, b]) for a in range(9) for b in range(a + 1, 9)}
    assert got == want


def test_entity_blocks_follow_from_the_budget(spark, monkeypatch):
    """The largest matrices of a task stay within the budget, and the result is that of one block."""
    from kindred.plans import gram

    rng = np.random.default_rng(8)
    rows = [(f"e{j}", i, float(rng.integers(0, 3))) for i in range(30) for j in range(200)]
    df = spark.createDataFrame(rows, "e string, i int, v double")
    dot = lambda m: np.nan_to_num(m).T @ np.nan_to_num(m)
    assert gram.blocks_for(200, 1) == 1
    budget = 3 * 8 * 60**2
    k = gram.blocks_for(200, 1, budget)
    assert k > 4
    # Entities in the largest pair of blocks, by the hash that deals them out.
    own = df.select("e").distinct().selectExpr(f"pmod(xxhash64(e), {k}) AS b").groupBy("b").count().collect()
    largest = sum(sorted(r["count"] for r in own)[-2:])
    assert 3 * 8 * largest**2 <= 1.5 * budget
    args = (df, "e", F.col("i"), F.floor(F.col("i") / 7), F.col("v"), {"d": dot})
    one = sorted((r.a, r.b, r.d) for r in pair_sums(*args).collect())
    assert len(one) == 200 * 199 // 2
    assert sorted((r.a, r.b, r.d) for r in pair_sums(*args, budget=budget).collect()) == one


@pytest.mark.parametrize("blocks", [1, 3])
def test_cutoff_loses_no_pair_that_reaches_it(spark, blocks):
    rng = np.random.default_rng(9)
    m = rng.integers(0, 4, (40, 25)) * (rng.random((40, 25)) < 0.3).astype(float)
    m[:, 3] = m[:, 4]
    rows = [(f"e{j}", i, float(m[i, j])) for i in range(40) for j in range(25) if m[i, j]]
    df = spark.createDataFrame(rows, "e string, i int, v double")
    dot = lambda x: np.nan_to_num(x).T @ np.nan_to_num(x)
    want = m.T @ m
    for least in (5.0, 20.0, float(want[3, 4])):
        got = pair_sums(df, "e", F.col("i"), F.floor(F.col("i") / 3), F.col("v"), {"d": dot}, blocks, cutoff=("d", least))
        got = {(r.a, r.b): r.d for r in got.collect()}
        pairs = {tuple(sorted((f"e{a}", f"e{b}"))): want[a, b] for a in range(25) for b in range(a)}
        assert got == {p: d for p, d in pairs.items() if d >= least}


def test_cutoff_refuses_negative_values(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, -1.0)], "e string, i int, v double")
    with pytest.raises(Exception, match="non-negative"):
        pair_sums(df, "e", F.col("i"), F.col("i"), F.col("v"), {"d": lambda m: m.T @ m}, 1, cutoff=("d", 0.5)).collect()


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(100).select("id", hash_int(F.lit(7), F.col("id")).alias("h"))
    again = spark.range(100).repartition(13).select("id", hash_int(F.lit(7), F.col("id")).alias("h"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, again.collect()))


def test_drawn_points_are_neither_broadcast_nor_in_one_task(spark):
    """The points come from one row that holds their number, which the planner takes for a small table."""
    from kindred.operators.replicates import uniform_interval_null

    ivals = spark.createDataFrame([("a", 0, 50_000), ("b", 100, 70_000)], "chrom string, start bigint, end bigint")
    n = spark.range(1).select(F.lit(30_000).cast("bigint").alias("n"))
    out = uniform_interval_null(ivals, n, 2, 7)
    assert [r.n_points for r in out.collect()] == [30_000, 30_000]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    ranged = [line for line in plan.splitlines() if "Join" in line and "__sbin" in line]
    assert ranged and all("SortMergeJoin" in line for line in ranged), plan
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_pairs_above_a_cutoff_are_not_shuffled(spark):
    """Their number grows with the square of the entities; the sums of a block pair are final in its task."""
    rnd = random.Random(4)
    rows = [(f"e{e}", i, rnd.random()) for e in range(20) for i in range(9)]
    df = spark.createDataFrame(rows, "e string, i bigint, v double")
    dot = lambda m: np.nan_to_num(m).T @ np.nan_to_num(m)
    out = pair_sums(df, "e", F.col("i"), F.col("i"), F.col("v"), {"d": dot}, cutoff=("d", 1.0))
    vectors = {f"e{e}": np.array([v for n, _, v in rows if n == f"e{e}"]) for e in range(20)}
    want = {(a, b) for a in vectors for b in vectors if a < b and vectors[a] @ vectors[b] >= 1.0}
    got = [(r.a, r.b) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInPandas")] and "HashAggregate" not in plan[: plan.index("MapInPandas")], plan


def test_rows_are_copied_by_their_number_and_not_for_small_matrices(spark):
    """With a cut-off a block pair is cut into tiles; its rows were copied once per block of a matrix that fits."""
    rng = np.random.default_rng(6)
    m = rng.integers(0, 4, (9, 120)) * (rng.random((9, 120)) < 0.6).astype(float)
    rows = [(f"e{j}", i, float(m[i, j])) for i in range(9) for j in range(120) if m[i, j]]
    df = spark.createDataFrame(rows, "e string, i int, v double")
    dot = lambda x: np.nan_to_num(x).T @ np.nan_to_num(x)
    for least in (12.0, 0.0):  # at 0 a pair must meet in a bucket
        out = pair_sums(df, "e", F.col("i"), F.floor(F.col("i") / 3), F.col("v"), {"d": dot}, cutoff=("d", least), budget=3 * 8 * 20**2)
        assert "sequence(0, 7" in out._jdf.queryExecution().analyzed().toString()
        got = [(r.a, r.b, r.d) for r in out.collect()]
        met = {p for b in range(3) for p in itertools.product(*[np.flatnonzero(m[3 * b : 3 * b + 3].any(axis=0))] * 2)}
        pairs = [(*sorted((f"e{a}", f"e{b}")), m[:, a] @ m[:, b]) for a in range(120) for b in range(a) if (a, b) in met]
        assert sorted(got) == sorted(p for p in pairs if p[2] >= least)


def test_null_items_and_entities_are_in_no_pair_of_a_cutoff(spark):
    rows = [("a", 1, 2.0), ("a", None, 5.0), ("b", 1, 3.0), ("b", None, 5.0), (None, 1, 9.0), (None, None, 9.0), ("c", None, 5.0), ("c", 2, 1.0)]
    df = spark.createDataFrame(rows, "e string, i int, v double")
    dot = lambda x: np.nan_to_num(x).T @ np.nan_to_num(x)
    for blocks in (None, 1):
        out = pair_sums(df, "e", F.col("i"), F.floor(F.col("i") / 3), F.col("v"), {"d": dot}, blocks, cutoff=("d", 1.0))
        assert [tuple(r) for r in out.collect()] == [("a", "b", 6.0)]
