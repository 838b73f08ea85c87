"""Hand-written boundary rows, one per rule."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kindred.functions import bases as fb
from kindred.functions import calls as fc
from kindred.functions import ids
from kindred.functions import special as sp
from kindred.operators import consensus as cs
from kindred.operators import coverage as cov
from kindred.operators import expression as ex
from kindred.operators import hypothesis as hy
from kindred.operators import kinship as kin
from kindred.operators import phasing as ph
from kindred.operators import regions as rg
from kindred.operators import replicates as rp
from kindred.operators import sequence as sq
from kindred.operators import spectrum as spec
from kindred.operators import trios as tr
from kindred.plans.cut import shared_base


def one(spark, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema)


# --- trios -----------------------------------------------------------------------------


@pytest.fixture
def pedigree(spark):
    ids_ = ["SP_family1_F_female", "SP_family1_M_male", "SP_family1_S1_offspring"]
    return spark.createDataFrame([("family1", *ids_)], "family string, mother string, father string, child string")


def call(pos, dps, gqs=(70, 70, 70), gts=("0/0", "0/0", "0/1"), samples=3):
    names = ["SP_family1_F_female", "SP_family1_M_male", "SP_family1_S1_offspring"]
    return [("c_1", pos, names[i], gts[i], dps[i], gqs[i], "A", "C") for i in range(samples)]


CALLS = "chrom string, pos bigint, sample string, gt string, dp int, gq int, ref string, alt string"


def depth_table(spark, mean=30.0):
    names = ["SP_family1_F_female", "SP_family1_M_male", "SP_family1_S1_offspring"]
    return spark.createDataFrame([(n, "c_1", mean) for n in names], "sample string, chrom string, mean_depth double")


def test_callable_bounds_are_inclusive(spark, pedigree):
    rows = (
        call(1, (15, 60, 30)) + call(2, (14, 60, 30)) + call(3, (15, 61, 30)) + call(4, (30, 30, 30), (60, 60, 60))
        + call(5, (30, 30, 30), (59, 60, 60)) + call(6, (None, 30, 30)) + call(7, (30, 30, 30), (None, 60, 60))
        + call(8, (30, 30, 30), samples=2)
    )
    ok = tr.with_call_ok(spark.createDataFrame(rows, CALLS), depth_table(spark))
    assert {r.pos for r in tr.callable_trio_sites(ok, pedigree).collect()} == {1, 4}


def test_missing_mean_depth_drops_the_site(spark, pedigree):
    means = depth_table(spark).filter("sample <> 'SP_family1_M_male'")
    ok = tr.with_call_ok(spark.createDataFrame(call(1, (30, 30, 30)), CALLS), means)
    assert tr.callable_trio_sites(ok, pedigree).count() == 0
    assert tr.callable_sites(ok, ["chrom", "pos"]).count() == 0


def test_absent_sample_fails_a_counted_site(spark):
    ok = spark.createDataFrame([("c", 1, True), ("c", 1, True), ("c", 2, True)], "chrom string, pos bigint, call_ok boolean")
    assert {r.pos for r in tr.callable_sites(ok, ["chrom", "pos"]).collect()} == {1, 2}
    assert {r.pos for r in tr.callable_sites(ok, ["chrom", "pos"], 2).collect()} == {1}


def test_rgq_is_used_when_gq_is_absent(spark):
    rows = [(None, 65, True), (None, 55, False), (59, 99, False), (None, None, False)]
    df = spark.createDataFrame([("s", "c_1", 30, g, r, ok) for g, r, ok in rows],
                               "sample string, chrom string, dp int, gq int, rgq int, want boolean")
    mean = spark.createDataFrame([("s", "c_1", 30.0)], "sample string, chrom string, mean_depth double")
    assert all(r.call_ok == r.want for r in tr.with_call_ok(df, mean, rgq="rgq").collect())


def test_ploidy_floor(spark):
    rows = [(1, 26, 13, 26, "d"), (2, 25, 13, 26, "d"), (3, 26, 12, 26, "d"), (4, 26, 13, 25, "d"), (5, 26, 13, 13, "s"), (6, 26, 13, 12, "s")]
    df = spark.createDataFrame(rows, "pos int, m_dp int, f_dp int, c_dp int, child string")
    sex = spark.createDataFrame([("d", "female"), ("s", "male")], "ind string, sex_id string")
    assert {r.pos for r in tr.ploidy_min_depth(df, sex, 26).collect()} == {1, 5}


def test_allele_balance_edges(spark):
    rows = [(7, 3), (3, 7), (71, 29), (29, 71), (0, 0), (1, 1)]
    df = spark.createDataFrame(rows, "c_ref_dp int, c_alt_dp int")
    kept = {(r.c_ref_dp, r.c_alt_dp) for r in tr.allele_balance(df).collect()}
    assert kept == {(7, 3), (3, 7), (1, 1)}


def test_multi_allelic_depths_are_dropped(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3],), (None,)], "ad array<int>")
    assert tr.two_allele_depths(df, "ad").count() == 1


def test_biallelic_text_and_arrays(spark):
    df = spark.createDataFrame([("A", "C"), ("A", "C,G"), ("AT", "A"), ("A", "."), ("A", "*")], "ref string, alt string")
    assert tr.biallelic_snps(df).count() == 1
    arr = df.withColumn("alt", F.split("alt", ","))
    assert tr.biallelic_snps(arr).count() == 1


def test_shared_parent_serves_two_families(spark):
    trios = spark.createDataFrame(
        [("f1", "m1", "dad", "k1"), ("f2", "m2", "dad", "k2")], "family string, mother string, father string, child string"
    )
    rows = [("c", 1, s, "0/0") for s in ("m1", "m2", "dad", "k1", "k2")]
    wide = tr.trio_wide(spark.createDataFrame(rows, "chrom string, pos int, sample string, gt string"), trios, ["gt"])
    assert {(r.family, r.father, r.child) for r in wide.collect()} == {("f1", "dad", "k1"), ("f2", "dad", "k2")}


def test_trios_need_both_parents(spark):
    names = ["SP_family1_F_x", "SP_family1_M_x", "SP_family1_S1_o", "SP_family1_S2_o", "SP_family2_F_x", "SP_family2_S1_o", "odd"]
    df = spark.createDataFrame([(n,) for n in names], "sample string")
    assert {(r.family, r.child) for r in tr.trios_from_samples(df).collect()} == {
        ("family1", "SP_family1_S1_o"), ("family1", "SP_family1_S2_o"),
    }
    assert {r.family for r in tr.incomplete_families(df).collect()} == {"family2", "odd"}


def test_mendel_verdicts(spark, pedigree):
    rows = []
    for pos in range(1, 11):
        rows += call(pos, (30, 30, 30), gts=("0/0", "1/1", "0/1" if pos <= 9 else "0/0"))
    df = spark.createDataFrame(rows + call(50, (20, 30, 30), gts=("0/0", "1/1", "1/1")), CALLS)
    good = tr.mendel_consistency(df, pedigree, min_sites=10).first()
    assert (good.n_informative, good.n_het, good.n_homref, good.verdict) == (10, 9, 1, "consistent")
    few = tr.mendel_consistency(df, pedigree, min_sites=11).first()
    assert few.consistency is None and few.verdict == "insufficient-sites"
    bad = tr.mendel_consistency(df, pedigree, min_sites=10, consistency_min=0.95).first()
    assert bad.verdict == "INCONSISTENT"


def test_missing_gq_does_not_mask(spark):
    df = spark.createDataFrame([("0/1", None, 30), ("0/1", 10, 30), ("0/1", 30, None)], "gt string, gq int, dp int")
    assert [r.gt for r in tr.mask_genotypes(df, 20, 26).collect()] == ["0/1", None, "0/1"]


# --- depth, windows, histograms ---------------------------------------------------------------


def test_last_window_is_clipped(spark):
    points = spark.createDataFrame([("c", 1), ("c", 100), ("c", 101), ("c", 230)], "chrom string, pos bigint")
    lengths = spark.createDataFrame([("c", 230), ("d", 50)], "chrom string, length bigint")
    got = sorted((r.chrom, r.window_start, r.window_end, r.n) for r in cov.window_counts(points, lengths, 100).collect())
    assert got == [("c", 1, 100, 2), ("c", 101, 200, 1), ("c", 201, 230, 1), ("d", 1, 50, 0)]


def test_alt_fraction_one_and_zero_depth(spark):
    rows = [("s", 0, 5), ("s", 0, 0), ("s", 5, 5), ("s", 71, 29), ("s", 43, 57)]
    got = {r.bin: r["count"] for r in cov.ad_histogram(spark.createDataFrame(rows, "s string, ref_dp int, alt_dp int"), ["s"]).collect()}
    assert len(got) == 100 and {k: v for k, v in got.items() if v} == {99: 1, 50: 1, 29: 1, 57: 1}


def test_uncovered_chromosome_has_no_statistics(spark):
    d = spark.createDataFrame([("s", "c", 1, 4), ("s", "c", 2, 0), ("s", "d", 1, 0)], "sample string, chrom string, pos int, depth int")
    lengths = spark.createDataFrame([("c", 8), ("d", 8)], "chrom string, length bigint")
    got = {r.chrom: r for r in cov.coverage_stats(d, lengths).collect()}
    assert (got["c"].covered_bases, got["c"].mean_all, got["c"].median_covered) == (1, 0.5, 4.0)
    assert got["d"].covered_bases == 0 and got["d"].mean_all == 0 and got["d"].median_covered is None


def test_chromosome_without_depth_rows_stays(spark):
    d = spark.createDataFrame([("s", "c", 1, 4), ("r", "d", 1, 2)], "sample string, chrom string, pos int, depth int")
    lengths = spark.createDataFrame([("c", 8), ("d", 8), ("e", 8)], "chrom string, length bigint")
    got = {(r.sample, r.chrom): r for r in cov.coverage_stats(d, lengths).collect()}
    assert len(got) == 6 and got["s", "e"].mean_all == 0 and got["s", "e"].mean_covered is None
    assert got["s", "e"].covered_bases == got["r", "c"].total_depth == 0 and got["r", "d"].mean_all == 0.25
    assert {r.chrom: r.mean_all for r in cov.coverage_stats(d.drop("sample"), lengths, ["chrom"]).collect()} == {"c": 0.5, "d": 0.25, "e": 0}


def test_candidates_before_and_after_the_shuffle_are_the_same(spark):
    rnd = np.random.default_rng(5)
    trios = spark.createDataFrame([("a", "F1", "M1", "c1"), ("a", "F1", "M1", "c2"), ("b", "c1", "M2", "c3")], "family string, mother string, father string, child string")
    pick = lambda x, p=None: str(rnd.choice(x, p=p))
    alts = [pick(["C", "CT", "C,G"], [0.8, 0.1, 0.1]) for _ in range(300)]
    rows = [
        ("x", p, s, "A", alts[p], pick(["0/0", "0/1", "./."], [0.6, 0.35, 0.05]) if rnd.random() > 0.03 else None, int(rnd.integers(5, 40)), bool(rnd.random() < 0.9))
        for p in range(300) for s in ("F1", "M1", "c1", "c2", "M2", "c3") if rnd.random() < 0.95
    ]
    calls = spark.createDataFrame(rows, "chrom string, pos int, sample string, ref string, alt string, gt string, dp int, call_ok boolean")
    late = tr.de_novo_candidates(tr.biallelic_snps(tr.callable_trio_sites(calls, trios, ["gt"], ["ref", "alt"])))
    early = tr.callable_candidates(calls, trios, ["gt"], ["ref", "alt"])
    assert early.columns == late.columns
    assert sorted(early.collect()) == sorted(late.collect()) != []
    below = early._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert len(below) == 2 and "call_ok" not in below[0] and all(x in below[1] for x in ("call_ok", "0/1", "[ACGT]"))


def test_repeated_parent_rows_give_one_answer(spark):
    trios = spark.createDataFrame([("a", "F", "M", "c")], "family string, mother string, father string, child string")
    rows = [("x", 1, "F", "0/1"), ("x", 1, "F", "0/0"), ("x", 1, "M", "0/0"), ("x", 1, "c", "0/1")]
    for order in (rows, rows[::-1]):
        calls = spark.createDataFrame(order, "chrom string, pos int, sample string, gt string")
        assert [r.m_gt for r in tr.trio_wide(calls, trios, ["gt"]).collect()] == ["0/0"]


def test_unset_shared_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_base(Session())
    Session.conf = {"spark.checkpoint.dir": "/shared"}
    assert shared_base(Session()) == "/shared"


def test_fit_that_has_not_converged_is_null():
    table = np.array([[[[5, 9], [2, 7]], [[8, 1], [3, 30]]]])
    assert np.isfinite(sp.ipf_g2(table)).all() and np.isnan(sp.ipf_g2(table, rounds=1)).all()


def test_fit_does_not_depend_on_the_size_of_the_counts():
    shares = np.random.default_rng(8).integers(1, 100, (200, 2, 2, 6))
    small, large = sp.ipf_g2(shares), sp.ipf_g2(shares * 10**8)
    assert np.isfinite(small).all() and np.isfinite(large).all()
    np.testing.assert_allclose(large, small * 1e8, rtol=1e-6)
    assert np.isnan(sp.ipf_g2(shares * 10**8, rounds=1)).all()


def test_callable_bounds_round_outwards(spark):
    df = spark.createDataFrame([(7,), (31,)], "p50 int")
    assert [(r.callable_min, r.callable_max) for r in cov.callable_bounds(df).collect()] == [(5, 14), (16, 62)]


def test_n50_with_ties_and_a_hot_assembly(spark):
    rnd = np.random.default_rng(2)
    rows = [("hot", int(x)) for x in rnd.integers(1, 200000, 300)] + [("b", 10), ("b", 10), ("b", 5)]
    got = {r.a: r for r in cov.nx(spark.createDataFrame(rows, "a string, length int"), ["a"]).collect()}
    for a in ("hot", "b"):
        v = sorted((x for k, x in rows if k == a), reverse=True)
        for p in (50, 90, 95):
            cum = np.cumsum(v)
            assert got[a][f"n{p}"] == v[int(np.argmax(cum >= sum(v) * p / 100))]


def test_runs_and_region_filter(spark):
    rows = [("c", i, flag == "x", flag == "p") for i, flag in enumerate("x.p..xxp.x...", start=1)]
    got = rg.runs(spark.createDataFrame(rows, "chrom string, site bigint, removed boolean, poly boolean"), ["chrom"], "site", "removed", "poly", width=3)
    assert sorted((r.start, r.end, r.n_poly) for r in got.collect()) == [(2, 6, 1), (8, 10, 1), (11, 14, 0)]


def test_singleton_chromosome_has_no_neighbour(spark):
    rows = [("a", 5), ("b", 1), ("b", 4), ("b", 10), ("d", 7), ("d", 7)]
    got = {(r.k, r.pos): r.distance for r in rg.nearest_neighbour(spark.createDataFrame(rows, "k string, pos bigint"), ["k"]).collect()}
    assert got == {("b", 1): 3, ("b", 4): 3, ("b", 10): 6, ("d", 7): 0}


def test_segments_keep_a_one_base_tail(spark):
    df = spark.createDataFrame([("s_X1", 5), ("s_10", 11), ("s_2", 10)], "chrom string, length bigint")
    got = [(r.interval, r.segment_id) for r in rg.make_segments(df, 5, "SP").orderBy("segment_id").collect()]
    assert got == [
        ("s_2:1-5", "SP_000"), ("s_2:6-10", "SP_001"), ("s_10:1-5", "SP_002"), ("s_10:6-10", "SP_003"),
        ("s_10:11-11", "SP_004"), ("s_X1:1-5", "SP_005"),
    ]


def test_codes_follow_first_appearance(spark):
    rows = [("b", 9), ("a", 40), ("b", 900), ("q", 9), ("d", 2)]
    got = rg.dense_codes(spark.createDataFrame(rows, "c string, i bigint"), "c", "i", width=4)
    assert {r.original: r.code for r in got.collect()} == {"d": 1, "b": 2, "q": 3, "a": 4}


def test_sex_contig_raises(spark):
    df = spark.createDataFrame([("c_1", 1), ("c_X2", 2)], "chrom string, i int")
    with pytest.raises(PySparkException):
        rg.dense_codes(df, "chrom", "i").collect()


# --- sequence ----------------------------------------------------------------------------------


def tiles(spark, seqs, bp):
    rows = []
    for chrom, s in seqs.items():
        for t in range(-(-len(s) // bp)):
            a, b = t * bp, min((t + 1) * bp, len(s))
            rows.append((chrom, t, a, (s[a - 1] if a else "N") + s[a:b] + (s[b] if b < len(s) else "N")))
    return spark.createDataFrame(rows, "chrom string, tile bigint, tile_start bigint, seq string")


GENOME = {"c": "ACGTNACCGGTTAACG", "n": "NNNNNNNN"}


def test_contexts_at_edges_mismatches_and_n(spark):
    sites = [("c", p, GENOME["c"][p - 1] if p != 7 else "T") for p in range(1, 17) if GENOME["c"][p - 1] != "N"] + [("n", 3, "A"), ("zz", 2, "A")]
    df = spark.createDataFrame(sites, "chrom string, pos bigint, ref string")
    lengths = spark.createDataFrame([(k, len(v)) for k, v in GENOME.items()], "chrom string, length bigint")
    got = {r.trinuc: r.n for r in sq.context_counts(df, tiles(spark, GENOME, 4), [], lengths, 4).collect()}
    want = {}
    for c, p, ref in sites:
        s = GENOME.get(c, "")
        if p < 2 or (s and p > len(s) - 1):
            k = "edge"
        else:
            ctx = s[p - 2 : p + 1] or "NNN"
            if "N" in ctx:
                k = "non_acgt"
            elif ctx[1] != ref:
                k = "ref_mismatch"
            else:
                k = ctx if ctx[1] in "CT" else ctx[::-1].translate(str.maketrans("ACGT", "TGCA"))
        want[k] = want.get(k, 0) + 1
    assert got == want


@pytest.mark.parametrize("trim", [0, 1, 3, 20])
def test_read_contexts(spark, trim):
    reads = [("a", "ACGTNACCGGTTAACG"), ("a", "acgtt"), ("b", "TT"), ("b", "CCCCCCC"), (None, "GATTACA")]
    got = {(r.k, r.trinuc): r.n for r in sq.read_context_counts(spark.createDataFrame(reads, "k string, seq string"), ["k"], trim).collect()}
    want = {}
    for k, s in reads:
        s = s.upper()
        for i in range(max(trim, 1), min(len(s) - trim, len(s) - 1)):
            ctx = s[i - 1 : i + 2]
            if set(ctx) <= set("ACGT"):
                f = ctx if ctx[1] in "CT" else ctx[::-1].translate(str.maketrans("ACGT", "TGCA"))
                want[(k, f)] = want.get((k, f), 0) + 1
    assert got == want


def test_consensus_mask_wins_and_flanks_follow(spark):
    selected = spark.createDataFrame([("c", 4, "G"), ("c", 5, "A"), ("c", 9, "T")], "chrom string, pos bigint, alt string")
    mask = spark.createDataFrame([("c", 8, 13)], "chrom string, start bigint, end bigint")
    s = list(GENOME["c"])
    for p, a in ((4, "G"), (5, "A"), (9, "T")):
        s[p - 1] = a
    s[8:13] = "N" * 5
    got = {(r.chrom, r.tile): r.seq for r in sq.seq_consensus(tiles(spark, GENOME, 4), selected, mask, tile_bp=4).collect()}
    want = {(r.chrom, r.tile): r.seq for r in tiles(spark, {"c": "".join(s), "n": GENOME["n"]}, 4).collect()}
    assert got == want


def test_cut_and_flip(spark):
    t = tiles(spark, GENOME, 4)
    cuts = spark.createDataFrame([("c", 3, 9)], "chrom string, start bigint, stop bigint")
    got = {(r.chrom, r.tile): r.seq for r in sq.cut_range(t, cuts, 4).collect()}
    want = {"c": GENOME["c"][:2] + GENOME["c"][9:], "n": GENOME["n"]}
    assert got == {(r.chrom, r.tile): r.seq for r in tiles(spark, want, 4).collect()}
    plan = spark.createDataFrame([("c", "z", True)], "chrom string, new_name string, flip boolean")
    lengths = spark.createDataFrame([(k, len(v)) for k, v in GENOME.items()], "chrom string, length bigint")
    flipped = GENOME["c"][::-1].translate(str.maketrans("ACGT", "TGCA"))
    got = {(r.chrom, r.tile): r.seq for r in sq.rename_and_flip(t, lengths, plan, 4).collect()}
    assert got == {(r.chrom, r.tile): r.seq for r in tiles(spark, {"z": flipped, "n": GENOME["n"]}, 4).collect()}


def test_isoform_tie_takes_the_first(spark):
    rows = [("g", "t2", 1, 9, 5), ("g", "t1", 1, 9, 6), ("g", "t3", 1, 3, 1)]
    best = sq.longest_isoform(spark.createDataFrame(rows, "gene string, mrna string, start int, stop int, file_order int")).first()
    assert (best.mrna, best.cds_length) == ("t2", 9)


def test_cds_checks_in_order(spark):
    rows = [("ATGTAAGG", "A", "A"), ("ATGTAAGGG", "A", "A"), ("ATGGGGTAA", "AAA", "AAA"), ("ATGGGGTAA", "ANN", "AAA"), ("ATGGGGTAA", "AAA", ""), ("NNNNNNTAA", "AAA", "AAA")]
    got = [r.reason for r in sq.cds_qc(spark.createDataFrame(rows, "ref string, s1 string, s2 string"), "ref", ["s1", "s2"]).collect()]
    assert got == ["length_not_divisible_by_3", "premature_stop_in_ref", "PASS", "s1_low_coverage", "s2_low_coverage", "ref_low_coverage"]


def test_codon_filter_needs_every_species(spark):
    rows = [("g", "a", "ATGNNNCCC"), ("g", "b", "ATGAAAC-C"), ("h", "a", "ATG")]
    got = sq.codon_callable_filter(spark.createDataFrame(rows, "gene string, species string, seq string"), 2).collect()
    assert sorted((r.gene, r.species, r.codon_no, r.codon) for r in got) == [("g", "a", 0, "ATG"), ("g", "b", 0, "ATG")]


# --- labels and identifiers ----------------------------------------------------------------------


def test_mutation_labels(spark):
    rows = [("A", "C", "G", "T"), ("C", "G", "T", "A"), ("A", "T", "A", "C"), ("A", "C", "N", "T"), ("A", "C", "G", "C"), ("t", "c", "a", "t")]
    df = spark.createDataFrame(rows, "b string, r string, a string, alt string")
    label, cpg, cpd = fb.mutation_labels("b", "r", "a", "alt")
    got = df.select(
        fb.sbs96("r", "alt", "b", "a").alias("cat"),
        fb.sbs_class7("r", "alt", F.concat("b", "r", "a")).alias("cls"),
        label.alias("m"), cpg.alias("cpg"), cpd.alias("cpd"),
    ).collect()
    assert [r.cat for r in got] == ["A[C>T]G", "A[C>T]G", "A[T>C]A", None, None, "T[C>T]A"]
    assert [r.cls for r in got] == ["C>T_CpG", "C>T_CpG", "T>C", None, None, "C>T_nonCpG"]
    assert [(r.m, r.cpg, r.cpd) for r in got][:3] == [
        ("C>T,CpG>TpG", True, False), ("C>T,CpG>TpG", True, False), ("T>C", False, False),
    ]
    assert got[5].m == "C>T,C>T_CPD" and got[5].cpd


def test_context_must_have_ref_at_its_centre(spark):
    df = spark.createDataFrame([("C", "T", "ATG"), ("C", "T", "AC")], "r string, alt string, ctx string")
    assert [r.c for r in df.select(fb.sbs_class7("r", "alt", "ctx").alias("c")).collect()] == [None, None]


def test_revcomp_of_ambiguity_codes(spark):
    assert one(spark, s="ACGTRYKMBDHVN").select(fb.revcomp("s").alias("x")).first().x == "NBDHVKMRYACGT"


def test_id_parsers(spark):
    df = one(spark, a="ABC_family1_S3_offspring", b="S_family2_S_x_S9_offspring", c="PE150_RUN1_L02_x.1.fq.gz", d="RUN1_L02_x_2.fq.gz", e="weird.fq.gz")
    r1, l1 = ids.run_and_lane("c")
    r2, l2 = ids.run_and_lane("d")
    r3, l3 = ids.run_and_lane("e")
    got = df.select(
        ids.family_key("a").alias("fk"), ids.family_key("b").alias("fk2"), ids.child_family_label("a").alias("fl"),
        ids.child_family_label("b").alias("fl2"), r1.alias("r1"), l1.alias("l1"), r2.alias("r2"), l2.alias("l2"), r3.alias("r3"), l3.alias("l3"),
    ).first()
    assert tuple(got) == ("ABC_family1", "S_family2_S_x", "ABC_family1", None, "RUN1", "L02", "RUN1", "L02", "NA", "NA")


def test_read_names(spark):
    df = spark.createDataFrame(
        [("/d/family1/x_F/r_1.fq", ), ("/d/family1/x-Male/r_2.fq",), ("/d/family2/y.3/r1.fq.gz",), ("/d/family2/y_S4/r_1.fq",)], "p string"
    )
    name, pair = ids.read_sample_name("p", F.lit("SP"))
    got = [(r.n, r.p) for r in df.select(name.alias("n"), pair.alias("p")).collect()]
    assert got == [("SP_family1_F_female", "1"), ("SP_family1_M_male", "2"), ("SP_family2_S3_offspring", "1"), ("SP_family2_S4_offspring", "1")]


def test_info_and_format_fields(spark):
    df = spark.createDataFrame([("DP=3;DB;AF=0.1,0.2;X=a=b",), ("K=1;K=2",), (".",), ("A=1;;B=2;",)], "i string")
    got = [dict(r.m) for r in df.select(fc.info_map("i").alias("m")).collect()]
    assert got == [{"DP": "3", "DB": "true", "AF": "0.1,0.2", "X": "a=b"}, {"K": "2"}, {}, {"A": "1", "B": "2"}]
    row = one(spark, f="GT:DP:GQ", v="0/1:.:7")
    got = row.select(*[fc.format_get("f", "v", k).alias(k) for k in ("GT", "DP", "GQ", "AD")]).first()
    assert tuple(got) == ("0/1", None, "7", None)


# --- loci and phase -------------------------------------------------------------------------------

DNM = "species string, family string, chrom string, pos bigint, ref string, alt string, child string, phased string"


def locus_rows(labels, pos=1, child="k{}"):
    return [("s", "f", "c", pos, "A", "C", child.format(i), p) for i, p in enumerate(labels)]


@pytest.mark.parametrize(
    "labels, want",
    [("P", "P"), ("PU", "P"), ("MUU", "M"), ("UU", "U"), ("FF", "F"), ("FP", "P"), ("FU", "U"), ("PM", "CONFLICT"), ("PMF", "CONFLICT")],
)
def test_locus_phase(spark, labels, want):
    df = spark.createDataFrame(locus_rows(labels), DNM)
    row = ph.loci(df).first()
    assert row.phase == want and row.sharing == ("shared" if len(labels) > 1 else "unique")


def test_conflict_can_raise(spark):
    df = spark.createDataFrame(locus_rows("PM"), DNM)
    with pytest.raises(PySparkException):
        ph.loci(df, on_conflict="raise").collect()


def test_ratio_without_maternal_loci_is_null(spark):
    df = spark.createDataFrame(locus_rows("P") + locus_rows("P", 2), DNM)
    rows = {(r.species, r.sharing): r for r in ph.phase_breakdown(ph.loci(df)).collect()}
    assert rows[("s", "unique")].bias is None and rows[("OVERALL", "unique")].n_P == 2
    assert all(r.sums_match for r in rows.values())


def test_zero_callable_and_zero_mutation_units(spark):
    bp = spark.createDataFrame([("s", "a", 100), ("s", "b", 0), ("s", "d", 50)], "species string, child string, bp bigint")
    dnm = spark.createDataFrame([("s", "a", 1), ("s", "a", 1), ("s", "a", 2), ("s", "b", 1)], "species string, child string, pos bigint")
    units = ph.unit_rates(dnm, bp, ["species", "child"], ["pos"])
    assert {(r.child, r.unique_dnms) for r in units.collect()} == {("a", 2), ("d", 0)}
    same = spark.createDataFrame([("s", 0, 10, 0.0), ("s", 0, 20, 0.0)], "species string, unique_dnms bigint, callable_sites bigint, rate double")
    row = ph.rate_dispersion(same, ["species"]).first()
    assert row.variance == 0.0 and row.cv == 0.0


def test_somatic_rows_that_do_not_count(spark):
    rows = [("C", "T", "ACG"), ("C", "C", "ACG"), ("A", "T", "CAG"), ("C", "T", "ATG"), ("C", "T", "AC"), ("T", "N", "ATG")]
    df = spark.createDataFrame([("s", *r) for r in rows], "species string, oriented_ref string, oriented_alt string, oriented_context string")
    assert spec.labelled_somatic(df).count() == 1
    assert tuple(spec.drop_counts(df, ["species"]).first()) == ("s", 6, 5)


def test_fold_change_without_counts_has_no_interval(spark):
    g = spark.createDataFrame([("s", 0, 10), ("t", 4, 10), ("u", 1, 0)], "species string, n_mutations bigint, denom bigint")
    s = spark.createDataFrame([("s", 3, 10), ("t", 4, 10), ("u", 1, 5)], "species string, n_mutations bigint, denom bigint")
    got = {r.species: r for r in spec.fold_change(g, s, ["species"]).collect()}
    assert got["s"].fold_change is None and got["s"].fc_low is None
    assert got["t"].fold_change == 2.0 and got["t"].log2_fc == 1.0 and got["t"].fc_low < 2 < got["t"].fc_high
    assert got["u"].germline_rate is None and got["u"].fold_change is None


# --- kinship, expression ------------------------------------------------------------------------------


def test_kinship_bands_with_missing_values(spark):
    rows = [(0.4, 0.0), (0.25, 0.001), (0.25, 0.1), (0.25, None), (0.1, 0.0), (0.05, 0.0), (0.0, 0.0), (None, 0.0), (float("nan"), 0.0)]
    got = [r.c for r in spark.createDataFrame(rows, "k double, i double").select(fc.degree_of_kinship("k", "i").alias("c")).collect()]
    assert got == ["duplicate/MZ", "parent-offspring", "full-sibling", "full-sibling", "2nd-degree", "3rd-degree", "unrelated", "NA", "NA"]


def test_pairs_join_in_either_order(spark):
    a = spark.createDataFrame([("x", "y", 1)], "id1 string, id2 string, p int")
    b = spark.createDataFrame([("y", "x", 2), ("z", "a", 3)], "id1 string, id2 string, q int")
    assert sorted((r.id1, r.id2, r.p, r.q) for r in kin.join_pairs(a, b).collect()) == [("a", "z", None, 3), ("x", "y", 1, 2)]


def test_zero_length_genes_have_zero_tpm(spark):
    df = spark.createDataFrame([("a", "s", 1000, 10), ("b", "s", 0, 99), ("c", "s", 500, 5)], "gene string, sample string, length bigint, count bigint")
    assert {r.gene: r.tpm for r in ex.tpm(df).collect()} == pytest.approx({"a": 5e5, "b": 0.0, "c": 5e5})


def test_unique_absence_needs_all_others(spark):
    rows = [
        ("me", "g1.t1.e1", "exon", 0.01), ("o", "g1.t1.e1", "exon", 0.5), ("o2", "g1.t1.e1", "exon", 0.05),
        ("me", "g2.t1.e1", "exon", 0.01), ("o", "g2.t1.e1", "exon", 0.04),
        ("me", "g3.t1", "gene", 0.0), ("me", "g4.t1.e1", "exon", 0.05),
    ]
    df = spark.createDataFrame(rows, "sample string, feature_id string, feature_type string, mean_scaled_dp double")
    assert {r.gene: r.unique_absent for r in ex.unique_absence(df, "me").collect()} == {"g1": 1, "g2": 0, "g3": 0, "g4": 0}


def test_alignment_check_raises(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "pos int, v string")
    b = spark.createDataFrame([(1, "p")], "pos int, w string")
    with pytest.raises(PySparkException):
        cs.assert_aligned(a, b, ["pos"]).collect()
    assert cs.assert_aligned(a.filter("pos = 1"), b, ["pos"]).count() == 1


def test_base_counts_respect_quality_per_base(spark):
    reads = spark.createDataFrame([("c", 10, "ACGT", [30, 10, 30, 30]), ("c", 11, "CC", [30, 30])], "chrom string, pos bigint, seq string, base_quality array<int>")
    sites = spark.createDataFrame([("c", 11), ("c", 12)], "chrom string, pos bigint")
    got = {r.pos: (r.n_A, r.n_C, r.n_G, r.n_T) for r in cs.site_base_counts(reads, sites).collect()}
    assert got == {11: (0, 1, 0, 0), 12: (0, 1, 1, 0)}


# --- tests and limits -------------------------------------------------------------------------------


def test_published_fisher_values():
    assert sp.fisher_one(106, 75, 5, 13)[0] == pytest.approx(0.02273, abs=5e-6)
    assert sp.fisher_one(27, 452, 0, 198)[0] == pytest.approx(0.0001141, abs=5e-8)


def test_published_poisson_limits():
    n, denom = np.array([249.0]), 54_147_318_556
    assert sp.gamma_quantile(0.025, n)[0] / denom == pytest.approx(4.05e-9, abs=5e-12)
    assert sp.gamma_quantile(0.975, n + 1)[0] / denom == pytest.approx(5.21e-9, abs=5e-12)


def test_gamma_functions_are_consistent():
    assert sp.gammaincc(1.0, 2.0) == pytest.approx(math.exp(-2))
    assert sp.gammaincc(0.5, 1.92) == pytest.approx(math.erfc(math.sqrt(1.92)))
    below, above = sp.gammaincc(9999.9, 10100.0), sp.gammaincc(10000.1, 10100.0)
    assert float(below) < float(above) and float(above - below) < 1e-3
    for a in (0.5, 3.0, 250.0, 5e5):
        x = sp.gamma_quantile(0.975, np.array([a]))
        assert 1 - sp.gammaincc(np.array([a]), x)[0] == pytest.approx(0.975, abs=1e-9)
    assert sp.gamma_quantile(0.025, np.array([0.0]))[0] == 0.0


def test_fisher_sums_large_tables_in_tails():
    two, greater = sp.fisher_one(500_000, 500_000, 500_500, 499_500)
    z = 2 * (0.5005 - 0.5) / math.sqrt(0.25 * 2 / 1e6) / 2
    assert two == pytest.approx(math.erfc(z / math.sqrt(2)), rel=0.02) and greater > 0.5


def test_zero_cells(spark):
    df = spark.createDataFrame([(5, 0, 3, 2), (0, 0, 3, 2)], "a int, b int, c int, d int")
    got = hy.fisher_2x2(df).collect()
    assert got[0].odds_ratio is None and 0 < got[0].p_two_sided <= 1
    assert got[1].p_two_sided is None
    assert one(spark, a=0, b=0, c=1, d=1).select(fc.log2_odds("a", "b", "c", "d").alias("x")).first().x == 0.0


def test_bh_with_ties_and_a_hot_family(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(p)) for p in np.round(rng.random(300) ** 3, 3)] + [("b", 0.04), ("b", 0.04), ("b", 0.9)]
    got = hy.bh_adjust(spark.createDataFrame(rows, "k string, p double"), ["k"], "p").collect()
    for k in ("hot", "b"):
        p = np.array([x for f, x in rows if f == k])
        order = np.argsort(p, kind="stable")
        adj = np.minimum(1, np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
        assert np.allclose(sorted(r.p_adjusted for r in got if r.k == k), np.sort(adj))


def test_mann_whitney_with_ties(spark):
    rows = [("k", v, g) for v, g in [(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 0), (5.0, 1), (5.0, 0), (-4.0, 1), (0.0, 0)]]
    r = hy.mann_whitney(spark.createDataFrame(rows, "k string, v double, g int"), ["k"], "v", F.col("g") == 1).first()
    first = [v for _, v, g in rows if g == 1]
    other = [v for _, v, g in rows if g == 0]
    u = sum((a > b) + 0.5 * (a == b) for a in first for b in other)
    assert (r.n1, r.n2, r.u1) == (4, 4, u) and 0 < r.p_value <= 1


def test_interaction_fit_matches_margins(spark):
    row = one(spark, y11=30, y12=50, y21=20, y22=90, e11=1000.0, e12=900.0, e21=1200.0, e22=800.0)
    got = hy.poisson_interaction(row).first().lrt_chi2
    y, e = np.array([[30.0, 50], [20, 90]]), np.array([[1000.0, 900], [1200, 800]])
    m = e.copy()
    for _ in range(500):
        m *= (y.sum(1) / m.sum(1))[:, None]
        m *= (y.sum(0) / m.sum(0))[None, :]
    assert got == pytest.approx(2 * float((y * np.log(y / m)).sum()))


def test_empirical_p_plus_one(spark):
    null = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "s double")
    obs = spark.createDataFrame([(3.0,)], "o double")
    plain = hy.empirical_p(null, obs, [], "s", "o").first()
    assert (plain.p_upper, plain.p_lower, plain.p_two_tailed) == (0.5, 0.75, 1.0)
    assert hy.empirical_p(null, obs, [], "s", "o", plus_one=True).first().p_upper == 3 / 5


def test_tree_distance(spark):
    rows = [("a", "r", 0), ("a", "x", 1), ("a", "a", 2), ("b", "r", 0), ("b", "x", 1), ("b", "b", 2), ("c", "r", 0), ("c", "c", 1)]
    got = {(r.a, r.b): r.distance for r in hy.tree_distance(spark.createDataFrame(rows, "leaf string, ancestor string, depth int")).collect()}
    assert got == {("a", "b"): 2.0, ("a", "c"): 3.0, ("b", "c"): 3.0}


def test_tree_distance_by_common_ancestors(spark):
    """A random forest: all pairs, chosen pairs, places of subtrees, and leaves of different trees."""
    rng = random.Random(4)
    parent = {f"t{i}": None for i in range(2)}
    for i in range(60):
        parent[f"n{i}"] = rng.choice([p for p in parent if not p.startswith("leaf")])
    for i in range(40):
        parent[f"leaf{i}"] = rng.choice([p for p in parent if not p.startswith("leaf")])
    lines = {}
    for leaf in (p for p in parent if p.startswith("leaf")):
        line, at = [], leaf
        while at is not None:
            line.insert(0, at)
            at = parent[at]
        lines[leaf] = line
    rows = [(leaf, a, d) for leaf, line in lines.items() for d, a in enumerate(line)]
    paths = spark.createDataFrame(rows, "leaf string, ancestor string, depth int")
    want = {}
    for a in lines:
        for b in lines:
            common = sum(x == y for x, y in zip(lines[a], lines[b]))
            if a < b and common:
                want[(a, b)] = float(len(lines[a]) + len(lines[b]) - 2 * common)
    assert {(r.a, r.b): r.distance for r in hy.tree_distance(paths).collect()} == want
    some = spark.createDataFrame([("leaf3", "leaf1"), ("leaf1", "leaf3"), ("leaf1", "leaf1"), ("leaf0", "none")], "a string, b string")
    got = {(r.a, r.b): r.distance for r in hy.tree_distance(paths, some).collect()}
    assert got == ({("leaf3", "leaf1"): want[("leaf1", "leaf3")], ("leaf1", "leaf3"): want[("leaf1", "leaf3")]} if ("leaf1", "leaf3") in want else {})
    order = hy.tree_order(paths)
    for r in hy.tree_intervals(paths, order).collect():
        assert r["last"] - r["first"] + 1 == sum(r.ancestor in line for line in lines.values())


def test_replicates_do_not_depend_on_order(spark):
    rows = [("s", f"k{i}", i % 5, 1000 + i) for i in range(30)]
    schema = "species string, child string, unique_dnms bigint, callable_sites bigint"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame(rows[::-1], schema).repartition(5)
    run = lambda d: sorted((r.rep, round(r.cv, 12)) for r in rp.poisson_null(d, ["species"], "child", 6, 1).collect())
    assert run(a) == run(b)
    boot = lambda d: sorted(map(tuple, rp.bootstrap_keys(d, "child", 3, 1, ["species"]).collect()))
    assert boot(a) == boot(b) and len(boot(a)) == 90


def test_poisson_draws_have_the_right_mean(spark):
    from kindred.plans.draws import uniform

    df = spark.range(4000).select(rp.poisson_draw(F.lit(7.5), uniform(F.lit(3), F.col("id"))).alias("k"))
    row = df.agg(F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    assert row.m == pytest.approx(7.5, abs=0.2) and row.v == pytest.approx(7.5, abs=0.6)


def test_multinomial_keeps_the_total(spark):
    counts = spark.createDataFrame([("k", "a", 70), ("k", "b", 0), ("k", "c", 30), ("one", "a", 5)], "k string, c string, n bigint")
    got = rp.bootstrap_multinomial(counts, ["k"], "c", "n", 40, 9).collect()
    per = {}
    for r in got:
        per.setdefault((r.k, r.rep), {})[r.c] = r.draws
    assert len(per) == 80 and all(sum(v.values()) == (100 if k == "k" else 5) for (k, _), v in per.items())
    assert 60 < np.mean([v["a"] for (k, _), v in per.items() if k == "k"]) < 80
    assert all(set(v) == {"a", "c"} for (k, _), v in per.items() if k == "k")


def test_multinomial_has_one_rule_for_all_totals(spark):
    """Draws do not depend on partitions, and large totals follow the same draws as small ones."""
    rows = [(str(t), c, int(t * w)) for t in (10, 10**3, 10**6, 10**9, 10**12) for c, w in (("a", 0.5), ("b", 0.2), ("c", 0.3))]
    counts = spark.createDataFrame(rows, "k string, c string, n bigint")
    a = sorted(map(tuple, rp.bootstrap_multinomial(counts, ["k"], "c", "n", 6, 9).collect()))
    assert a == sorted(map(tuple, rp.bootstrap_multinomial(counts.repartition(7), ["k"], "c", "n", 6, 9).collect()))
    per = {}
    for k, rep, c, draws, _ in a:
        per[(k, rep)] = per.get((k, rep), 0) + draws
        weight = {"a": 0.5, "b": 0.2, "c": 0.3}[c]
        assert abs(draws - int(k) * weight) < 6 * (int(k) * weight) ** 0.5
    assert per == {(str(t), r): t for t in (10, 10**3, 10**6, 10**9, 10**12) for r in range(6)}


def test_binomial_quantile_by_its_definition(monkeypatch):
    from math import comb

    rng = np.random.default_rng(5)
    for n, l, r in [(1, 1, 1), (5, 1, 3), (40, 7, 2), (300, 1, 90), (0, 1, 1), (7, 0, 3), (7, 3, 0)]:
        u = np.r_[rng.random(50), 0.0, 1 - 2.0**-48]
        got = sp.binomial_quantile(np.full(52, n), np.full(52, l), np.full(52, r), u)
        p = l / (l + r)
        cdf = np.cumsum([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        want = [min(int(np.searchsorted(cdf, x)), n) for x in u]
        assert np.abs(got - want)[:50].max(initial=0) == 0 and (got >= 0).all() and (got <= n).all()
    big = [np.full(3, 10.0**9), np.full(3, 0.3), np.full(3, 0.7), np.array([0.1, 0.5, 0.9])]
    whole = sp.binomial_quantile(*big)
    monkeypatch.setattr(sp, "_WIDEST", 1000)
    assert np.array_equal(sp.binomial_quantile(*big), whole)


def test_a_million_fisher_tables():
    from math import comb

    rng = np.random.default_rng(2)
    a, b, c, d = rng.integers(0, 40, (4, 1_000_000))
    two, greater = sp.fisher_tables(a, b, c, d)
    for i in range(0, 1_000_000, 9973):
        n1, n2, m1 = int(a[i] + b[i]), int(c[i] + d[i]), int(a[i] + c[i])
        lo, hi = max(0, m1 - n2), min(n1, m1)
        mass = {x: comb(n1, x) * comb(n2, m1 - x) / comb(n1 + n2, m1) for x in range(lo, hi + 1)} if n1 + n2 else {0: 1.0}
        own = mass[int(a[i])] * (1 + 1e-7)
        assert two[i] == pytest.approx(min(1.0, sum(v for v in mass.values() if v <= own)), rel=1e-9)
        assert greater[i] == pytest.approx(min(1.0, sum(v for x, v in mass.items() if x >= a[i])), rel=1e-9)


def test_fisher_tables_far_in_the_tail():
    """A tail below the smallest mass that a difference from 1 could show, and very large tables."""
    two, greater = sp.fisher_tables([90, 10**6, 0], [5, 10**6, 0], [7, 10**6 + 500, 3], [98, 10**6 - 500, 4])
    assert 0 < greater[0] < 1e-30 and greater[0] <= two[0] < 1e-30
    assert 0.4 < two[1] < 0.7 and two[2] == 1.0


def test_lane_matrix_has_every_flowcell(spark):
    """A row per individual and flowcell; no flowcell is folded into ``others``, equal lanes stay apart."""
    from kindred.operators import batch as bt

    rows = [("i1", "V1", "L01", 1.0), ("i1", "V9", "L01", 2.0), ("i1", "V9", "L07", 4.0), ("i2", "V9", "L09", 8.0)]
    lanes = spark.createDataFrame(rows, "individual string, round_id string, lane string, coverage double")
    got = bt.lane_matrix(lanes, ["L01", "L07"], ["individual", "round_id"]).collect()
    assert {tuple(r) for r in got} == {("i1", "V1", 1.0, 0.0, 0.0), ("i1", "V9", 2.0, 4.0, 0.0), ("i2", "V9", 0.0, 0.0, 8.0)}
    with pytest.raises(ValueError):
        bt.lane_matrix(lanes, ["L01"])


def test_lane_matrix_query_keeps_all_lanes_of_all_flowcells(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    wide = entry.queries()["agg60_lane_matrix"](spark, sf)
    assert {"individual", "round_id", *[f"L0{i}" for i in range(1, 8)]} <= set(wide.columns)
    long = entry.queries()["agg60_lane_coverage"](spark, sf)
    assert wide.count() == long.select("individual", "round_id").distinct().count()


def test_hierarchical_draws_meet_their_loci_without_a_shuffle(spark):
    """Loci are grouped once; the rows of all draws are counted in place, a locus of two drawn offspring once."""
    loci = [("A", "f1", f"l{i}", k, "PMU"[i % 3]) for i in range(30) for k in ("k1", "k2")]
    loci = spark.createDataFrame(loci, "species string, family string, locus string, child string, phase string")
    bp = spark.createDataFrame([("A", "f1", k, 100) for k in ("k1", "k2")], "species string, family string, child string, bp bigint")
    out = rp.bootstrap_hierarchical(loci, bp, 4, 3)
    assert [r.n_p + r.n_m for r in out.collect()] == [30] * 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in plan and "Aggregate [species" in plan
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "fam_slot" in x.split("]")[0] and "locus" in x.split("]")[0]], plan
