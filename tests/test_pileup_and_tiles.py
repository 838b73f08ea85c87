"""Gapped pileup and packed sequence tiles against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import consensus as cs
from kindred.operators import sequence as sq

CIGARS = ["8M", "3S5M", "2M2D4M2S", "1H3M2I3M", "2M900N6M", "4=1X3=", "1S1M1I1D1X2N4M", "*", None, "8I", "8S", "2M1P2I4M", "3M0D5M"]


def pile(rows, sites, floor, per_base):
    counts = {s: [0] * 4 for s in sites}
    for chrom, pos, seq, quality, cigar in rows:
        ref, own, n = pos, 0, ""
        for letter in cigar if cigar and cigar != "*" else "":
            if letter.isdigit():
                n += letter
                continue
            k, n = int(n), ""
            if letter in "M=X":
                for j in range(k):
                    q = quality[own + j] if per_base else quality
                    b = seq[own + j].upper()
                    if (chrom, ref + j) in counts and q >= floor and b in "ACGT":
                        counts[(chrom, ref + j)]["ACGT".index(b)] += 1
            ref += k if letter in "MDN=X" else 0
            own += k if letter in "MIS=X" else 0
    return {s: tuple(c) for s, c in counts.items() if any(c)}


@pytest.mark.parametrize("width,salts,per_base", [(4, 1, True), (4, 3, False), (512, 8, True)])
def test_gapped_pileup(spark, width, salts, per_base):
    rng = random.Random(width)
    rows = []
    for i in range(300):
        seq = "".join(rng.choice("ACGTNacgt") for _ in range(8))
        quality = [rng.randrange(40) for _ in range(8)] if per_base else rng.randrange(40)
        rows.append(("hot" if i % 2 else "c", rng.randrange(1, 40) if i % 3 else 905, seq, quality, rng.choice(CIGARS)))
    kind = "array<int>" if per_base else "int"
    reads = spark.createDataFrame(rows, f"chrom string, pos bigint, seq string, base_quality {kind}, cigar string")
    sites = [(c, p) for c in ("hot", "c", "none") for p in [*range(1, 60), 905, 910, 1500]]
    frame = spark.createDataFrame(sites + sites[:5], "chrom string, pos bigint")
    got = cs.site_base_counts(reads, frame, 20, width, cigar="cigar", salts=salts).collect()
    assert {(r["chrom"], r["pos"]): (r["n_A"], r["n_C"], r["n_G"], r["n_T"]) for r in got} == pile(rows, sites, 20, per_base)


def test_pileup_of_long_reads_has_no_more_bases_than_the_reads(spark):
    reads = spark.createDataFrame([("c", 1, "A" * 5000, 30, "100M" * 50)], "chrom string, pos bigint, seq string, base_quality int, cigar string")
    blocks = cs.aligned_blocks(reads)
    assert blocks.agg(F.sum(F.length("seq"))).first()[0] == 5000 and blocks.count() == 50


def test_only_heterozygotes_need_reads(spark):
    snps = spark.createDataFrame(
        [("c", 1, "A", "G", "0/1"), ("c", 2, "A", "G", "1|0"), ("c", 3, "A", "G", "1/1"), ("c", 4, "AT", "G", "0/1"), ("c", 5, "A", "G", None)],
        "chrom string, pos bigint, ref string, alt string, gt string",
    )
    assert sorted(r["pos"] for r in cs.heterozygous_snps(snps).collect()) == [1, 2]
    reads = spark.createDataFrame([("c", 1, "AAAAA", 30), ("c", 1, "GGGGG", 30), ("c", 2, "TT", 30)], "chrom string, pos bigint, seq string, base_quality int")
    got = {r["pos"]: r["reason"] for r in cs.classify_by_reads(snps, reads).collect()}
    assert got == {1: "pass_het_clean", 2: "third_base_support", 3: "pass_hom_alt", 4: "non_simple_snp", 5: "invalid_gt"}


@pytest.mark.parametrize("tile_bp", [1, 7, 29, 31, 60, 62, 64, 1000])
def test_packed_tiles(spark, tile_bp):
    rng = random.Random(tile_bp)
    texts = {"c": "".join(rng.choice("ACGTacgt") for _ in range(301)), "n": "".join(rng.choice("ACGTNNR") for _ in range(180))}
    rows = []
    for chrom, s in texts.items():
        for t in range(-(-len(s) // tile_bp)):
            a, b = t * tile_bp, min((t + 1) * tile_bp, len(s))
            rows.append((chrom, t, a, (s[a - 1] if a else "N") + s[a:b] + (s[b] if b < len(s) else "N")))
    tiles = spark.createDataFrame(rows, "chrom string, tile bigint, tile_start bigint, seq string")
    places = [(c, p) for c in ("c", "n", "zz") for p in range(-1, 305)]
    sites = spark.createDataFrame(places, "chrom string, pos bigint")
    for side in (tiles, sq.pack_tiles(tiles)):
        got = {(r["chrom"], r["pos"]): r["context"] for r in sq.sequence_lookup(sites, side, tile_bp=tile_bp).collect()}
        for c, p in places:
            s = texts.get(c, "")
            want = "NNN"
            if 1 <= p <= len(s):
                want = "".join(x if x in "ACGT" else "N" for x in ("N" + s + "N")[p - 1 : p + 2].upper())
            assert got[(c, p)] == want


def test_packed_tiles_take_about_two_bits_a_base(spark):
    tiles = spark.createDataFrame([("c", 0, 0, "ACGT" * 8192)], "chrom string, tile bigint, tile_start bigint, seq string")
    row = sq.pack_tiles(tiles).select(F.size("words").alias("w"), F.size("masks").alias("m")).first()
    assert row["w"] * 8 < 32768 * 2.3 / 8 and row["m"] == 0


def test_consensus_edits_are_linear(spark):
    n = 20_000
    tiles = spark.createDataFrame([("c", 0, 0, "N" + "A" * n + "N"), ("d", 0, 0, "NCCN")], "chrom string, tile bigint, tile_start bigint, seq string")
    edits = spark.range(1, n + 1).select(F.lit("c").alias("chrom"), F.col("id").alias("pos"), F.lit("G").alias("alt"))
    mask = spark.createDataFrame([("c", 5, 10), ("c", 7, 12), ("c", n - 1, n + 5)], "chrom string, start bigint, end bigint")
    got = {r["chrom"]: r["seq"] for r in sq.seq_consensus(tiles, edits, mask).collect()}
    want = ["G"] * n
    want[5:12] = "N" * 7
    want[n - 1 :] = "N"
    assert got == {"c": "N" + "".join(want) + "N", "d": "NCCN"}


def test_sites_of_a_pileup_travel_as_one_row_per_bin(spark):
    """Sites are repeated for the salts as rows of a bin, not one by one, and the pieces are not sorted."""
    reads = spark.range(200).select(
        F.lit("c").alias("chrom"), (F.col("id") % 40 + 1).alias("pos"), F.lit("ACGTACGT").alias("seq"), F.lit(30).alias("base_quality")
    )
    sites = spark.range(1, 1001).select(F.lit("c").alias("chrom"), (F.col("id") % 500 + 1).cast("int").alias("pos"))
    out = cs.site_base_counts(reads, sites, width=64)
    got = out.collect()
    assert dict(out.dtypes)["pos"] == "int" and sorted(r["pos"] for r in got) == list(range(1, 48))
    assert sum(r["n_A"] + r["n_C"] + r["n_G"] + r["n_T"] for r in got) == 200 * 8
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "collect_set" in plan and "SortMergeJoin" not in plan


def test_tiles_of_coding_sequence_are_not_broadcast(spark):
    parts = [("g", "t", "c", "+", 2, 4, 0), ("g", "t", "c", "+", 6, 7, 1)]
    cds = spark.createDataFrame(parts, "gene string, mrna string, chrom string, strand string, start bigint, stop bigint, file_order bigint")
    tiles = spark.range(1).select(F.lit("c").alias("chrom"), F.col("id").alias("tile"), F.lit("NACGTACGN").alias("seq"))
    out = sq.cds_sequence(cds, tiles)
    assert [r["cds"] for r in out.collect()] == ["CGTCG"]
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()


def test_looked_up_tiles_are_not_broadcast(spark):
    tiles = spark.range(1).select(F.lit("c").alias("chrom"), F.col("id").alias("tile"), F.lit("NACGTN").alias("seq"))
    sites = spark.range(1, 3).select(F.lit("c").alias("chrom"), F.col("id").alias("pos"))
    out = sq.sequence_lookup(sites, tiles)
    assert sorted(tuple(r) for r in out.collect()) == [("c", 1, "NAC"), ("c", 2, "ACG")]
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["agg06_base_composition", "agg08_context_counts"])
def test_tiles_are_dealt_out_before_they_are_spelled(spark, name):
    """Texts are made of short rows by many tasks, and sites carry a bit for each call, not the calls."""
    import __spark_entry__ as e

    plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.index("RepartitionByExpression")
    assert "md5(" in plan[:dealt] and "md5(" not in plan[dealt:] and "l_quantity" not in plan.split("Relation")[0]


def test_consensus_takes_few_long_tiles_a_batch(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        tiles = spark.createDataFrame([("c", 0, 0, "NACN")], "chrom string, tile bigint, tile_start bigint, seq string")
        edits = spark.createDataFrame([("c", 1, "G")], "chrom string, pos bigint, alt string")
        mask = spark.createDataFrame([("c", 1, 2)], "chrom string, start bigint, end bigint")
        assert [r["seq"] for r in sq.seq_consensus(tiles, edits, mask).collect()] == ["NGNN"]
        assert int(spark.conf.get(key)) * sq.TILE_BP <= 1 << 22
    finally:
        spark.conf.set(key, before)
