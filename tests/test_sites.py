"""The site-wide form against the long form, and the exchanges it avoids."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kindred.operators import sites as si
from kindred.operators import trios as tr
from kindred.plans import spans
from kindred.sources import calls as sc

PEDIGREE = [("f1", "m1", "p1", "a"), ("f1", "m1", "p1", "b"), ("f2", "a", "p2", "d"), ("f3", "m1", "gone", "e")]
ORDER = ["p1", "m1", "a", "b", "p2", "d", "extra"]
CALL = "chrom string, pos bigint, ref string, alt string, sample string, gt string, dp int, gq int, rgq int"


def long_rows(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        chrom = "hot" if rng.random() < 0.5 else f"c{rng.randrange(3)}"
        ref, alt = rng.choice(["A", "C", "AT"]), rng.choice(["G", "T", "G,T", "GA"])
        for s in ORDER:
            if rng.random() < 0.85:
                gt = rng.choice(["0/0", "0/0", "0/0", "0/1", "0/1", "1/1", None])
                dp, gq = rng.choice([None, 5, 90, *[28, 30, 31] * 5]), rng.choice([None, 20, *[60, 99] * 5])
                rows.append((chrom, i + 1, ref, alt, s, gt, dp, gq, rng.choice([None, 60, 10])))
    return rows


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(long_rows(), CALL)


@pytest.fixture(scope="module")
def pedigree(spark):
    return spark.createDataFrame(PEDIGREE, "family string, mother string, father string, child string")


@pytest.fixture(scope="module")
def panel(pedigree):
    return si.panel(ORDER, pedigree)


@pytest.fixture(scope="module")
def wide(calls, panel):
    return si.from_long(calls, panel, ["gt", "dp", "gq", "rgq"], site_fields=["ref", "alt"])


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def with_ok(calls):
    mean = calls.groupBy("sample", "chrom").agg(F.avg("dp").alias("mean_depth"))
    return tr.with_call_ok(calls, mean)


def test_long_and_back(calls, wide, panel):
    columns = ["chrom", "pos", "sample", "gt", "dp", "gq", "rgq"]
    assert rows_of(si.to_long(wide, panel, ["chrom", "pos"]), columns) == rows_of(calls, columns)


def test_same_rows_as_the_long_form(calls, wide, panel, pedigree):
    sites = si.with_means(wide, si.mean_depths(wide, panel))
    ok = with_ok(calls)
    columns = ["chrom", "pos", "family", "father", "mother", "child", "f_dp", "m_dp", "c_dp"]
    want = rows_of(tr.callable_trio_sites(ok, pedigree), columns)
    assert want and rows_of(si.callable_trio_sites(sites, panel), columns) == want
    columns += ["ref", "alt", "c_gt"]
    want = rows_of(tr.callable_candidates(ok, pedigree, site_fields=["ref", "alt"]), columns)
    assert want and rows_of(si.callable_candidates(sites, panel, site_fields=["ref", "alt"]), columns) == want
    columns = ["chrom", "pos", "child", "f_gt", "m_gt", "c_gt"]
    assert rows_of(si.trio_sites(wide, panel), columns) == rows_of(tr.trio_sites(calls, pedigree), columns)
    for n in (None, len(ORDER)):
        assert rows_of(si.callable_sites(sites, ["chrom", "pos"], n), ["chrom", "pos", "n_calls"]) == rows_of(
            tr.callable_sites(ok, ["chrom", "pos"], n), ["chrom", "pos", "n_calls"]
        )


def test_mendel_as_in_the_long_form(calls, wide, panel, pedigree):
    new = si.mendel_consistency(wide, panel, pedigree, 30, 10, 0.5, 3)
    old = tr.mendel_consistency(calls, pedigree, 30, 10, 0.5, 3)
    assert rows_of(new, old.columns) == rows_of(old, old.columns)
    assert any(r["n_informative"] for r in new.collect())


def test_reference_quality_needs_a_missing_field(spark):
    """A GQ field with a missing value is 0; only sites without the field use RGQ."""
    rows = [(True, None, 99), (True, 60, None), (False, None, 60), (False, None, None), (True, 59, 99)]
    df = spark.createDataFrame(rows, "has_gq boolean, gq int, rgq int").withColumn("call", F.struct(F.lit(10).alias("dp"), "gq", "rgq"))
    got = df.select(si.call_passes(F.col("call"), F.lit(10.0), has_gq="has_gq").alias("ok")).collect()
    assert [r["ok"] for r in got] == [False, True, True, False, False]


def test_exempt_rows_pass_allele_balance(spark):
    rows = [("female", 5, 5), ("female", 0, 9), ("male", 0, 9), ("male", 0, 0), ("female", 0, 0)]
    df = spark.createDataFrame(rows, "sex_id string, c_ref_dp int, c_alt_dp int")
    got = tr.allele_balance(df, exempt=F.col("sex_id") == "male").collect()
    assert sorted(map(tuple, got)) == [("female", 5, 5), ("male", 0, 0), ("male", 0, 9)]


LINES = [
    "##fileformat=VCFv4.2",
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tp1\tm1\ta",
    "c\t1\t.\tA\tG\t.\tPASS\tDB;AC=1\tGT:DP:GQ:AD\t0/0:10:60:9,1\t0|0:11:.:9,0\t0/1:12:70:6,6",
    "c\t2\trs\tA\t.\t5.5\t.\t.\tGT:DP:RGQ\t0/0:10:60\t./.\t0/0:.:7",
]


def test_site_lines_hold_what_call_lines_hold(spark):
    rows = spark.createDataFrame([("file:///x.vcf", v) for v in LINES], "path string, value string")
    sites = sc.parse_sites(rows)
    assert [r["has_gq"] for r in sites.orderBy("pos").collect()] == [True, False]
    order = si.Panel(("p1", "m1", "a"))
    columns = ["chrom", "pos", "sample", "gt", "dp", "gq", "rgq", "ad"]
    assert rows_of(si.to_long(sites, order, ["chrom", "pos"]), columns) == rows_of(sc.parse_calls(rows), columns)


def test_files_as_sites(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("\n".join(LINES) + "\n")
    path = str(tmp_path / "x.vcf")
    assert sc.sample_order(spark, path) == ["p1", "m1", "a"]
    assert sc.read_sites(spark, path).select("pos", F.size("calls").alias("n")).orderBy("pos").collect() == [(1, 3), (2, 3)]


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"^.*\bExchange (?!SinglePartition)\w+.*$", re.sub("BroadcastExchange", "Sent", text), re.M)


def test_no_exchange_between_scan_and_candidates(spark, wide, panel, tmp_path):
    path = str(tmp_path / "sites")
    wide.write.parquet(path)
    stored = spark.read.parquet(path)
    sites = si.with_means(stored, si.mean_depths(stored, panel))
    assert exchanges(si.callable_candidates(sites, panel, site_fields=["ref"])) == []
    assert exchanges(si.callable_trio_sites(sites, panel)) == []
    # Isolation is the only shuffle, and the candidates are planned once.
    lone = spans.isolated_rows(si.callable_candidates(sites, panel), ["child", "chrom"], "pos")
    plan = lone._jdf.queryExecution().executedPlan().toString()
    assert len(exchanges(lone)) == 1
    assert len(re.findall(r"\+- FileScan parquet.*calls", plan)) == 1


def test_calls_are_not_moved_to_their_means(spark, calls, tmp_path):
    path = str(tmp_path / "calls")
    calls.write.parquet(path)
    stored = spark.read.parquet(path)
    assert exchanges(with_ok(stored)) == []


@pytest.mark.parametrize("distance", [1, 7, 150])
def test_isolated_rows_as_drop_crowded(spark, distance):
    rng = random.Random(distance)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", rng.randrange(-900, 9000), i) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:20] + [("hot", None, -1)], "chrom string, pos bigint, i int")
    got = spans.isolated_rows(df, ["chrom"], "pos", distance, width=4)
    assert rows_of(got, df.columns) == rows_of(spans.drop_crowded(df, ["chrom"], "pos", distance), df.columns)


@pytest.mark.parametrize("name", ["src01_read_calls", "src01_read_sites"])
def test_lines_are_made_and_read_once(spark, name):
    """Headers are known before the lines: no second pass over the tables looks for them."""
    import __spark_entry__ as e

    plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) == 1 and plan.count("concat_ws(\t,") == 1


def test_texts_are_split_once_and_headers_among_lines_are_stored(spark, tmp_path):
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "a", "b"])
    lines = [("f", head), ("f", "c\t5\t.\tA\tG\t.\tPASS\tDB\tGT:DP\t0/1:7\t./.:."), ("f", "c\t9\t.\tA\tG\t.\tPASS\tDB\tGT:DP\t1|1:.\t0/0:3")]
    spark.createDataFrame(lines, "path string, value string").write.parquet(str(tmp_path / "lines"))
    called = sc.parse_calls(spark.read.parquet(str(tmp_path / "lines"))).filter("gt IS NOT NULL")
    plan = called._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    assert not any("split(" in x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter"))
    assert sorted((r["pos"], r["sample"], r["gt"], r["dp"]) for r in called.collect()) == [(5, "a", "0/1", 7), (9, "a", "1/1", None), (9, "b", "0/0", 3)]
