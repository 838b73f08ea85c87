"""Readers and writers on small files."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.sources import calls, dims, sequence, sinks, tables


def test_calls_from_files_with_different_samples(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(
        head + "s1\ts2\n" + "c_1\t5\t.\tA\tC,G\t50\tPASS\tAF=0.1,0.2;DB\tGT:AD:DP:GQ\t0|1:3,4:7:60\t./.:.:.:.\n"
    )
    (tmp_path / "b.vcf").write_text(head + "s3\n" + "c_2\t9\trs1\tT\t.\t.\t.\t.\tGT:DP:RGQ\t0/0:12:33\n")
    got = {r["sample"]: r for r in calls.read_calls(spark, str(tmp_path / "*.vcf")).collect()}
    assert set(got) == {"s1", "s2", "s3"}
    a = got["s1"]
    assert (a.chrom, a.pos, a.id, a.alt, a.qual, a.filter, a.gt, a.dp, a.gq, a.rgq, a.ad) == (
        "c_1", 5, None, ["C", "G"], 50.0, "PASS", "0/1", 7, 60, None, [3, 4],
    )
    assert a.info == {"AF": "0.1,0.2", "DB": "true"}
    assert got["s2"].gt is None and got["s2"].dp is None
    assert (got["s3"].rgq, got["s3"].gq, got["s3"].filter, got["s3"].info) == (33, None, None, {})


@pytest.mark.parametrize("tile_bp, per_task", [(7, 2), (10, 1), (64, 256)])
def test_sequence_tiles(spark, tmp_path, tile_bp, per_task):
    rnd = random.Random(tile_bp)
    genome = {"c1": "".join(rnd.choice("acgtN") for _ in range(83)), "c2": "ACGTA", "c3": "G" * 20}
    text, index = "", ""
    for name, s in genome.items():
        text += f">{name} note\n"
        index += f"{name}\t{len(s)}\t{len(text)}\t10\t11\n"
        text += "".join(s[i : i + 10] + "\n" for i in range(0, len(s), 10))
    (tmp_path / "g.fa").write_text(text)
    (tmp_path / "g.fa.fai").write_text(index)
    df = sequence.read_sequence_tiles(spark, str(tmp_path / "g.fa"), tile_bp, tiles_per_task=per_task)
    got = {(r.chrom, r.tile): (r.tile_start, r.seq) for r in df.collect()}
    for name, s in genome.items():
        s = "N" + s.upper() + "N"
        n = -(-(len(s) - 2) // tile_bp)
        for t in range(n):
            a, b = t * tile_bp, min((t + 1) * tile_bp, len(s) - 2)
            assert got.pop((name, t)) == (a, s[a : b + 2])
    assert not got
    assert [r.length for r in tables.read_fai(spark, str(tmp_path / "g.fa.fai")).orderBy("chrom").collect()] == [83, 5, 20]


@pytest.mark.parametrize("tile_bp, per_task", [(7, 1), (10, 3), (64, 256)])
def test_tiles_written_and_read_back(spark, tmp_path, tile_bp, per_task):
    rnd = random.Random(tile_bp)
    rows = []
    for name, n in (("c1", 83), ("c2", 5), ("gap", 90)):
        s = "N" + "".join(rnd.choice("ACGTN") for _ in range(n)) + "N"
        for t in range(-(-n // tile_bp)):
            if name != "gap" or t != 1:
                a, b = t * tile_bp, min((t + 1) * tile_bp, n)
                rows.append((name, t, a, s[a : b + 2]))
    df = spark.createDataFrame(rows, "chrom string, tile bigint, tile_start bigint, seq string").repartition(4)
    folder = str(tmp_path / "tiles")
    sequence.write_sequence_tiles(df, folder, tile_bp)
    got = {(r.chrom, r.tile): (r.tile_start, r.seq) for r in sequence.read_sequence_parts(spark, folder, per_task).collect()}
    kept = {(c, t) for c, t, _, _ in rows}
    for c, t, a, seq in rows:
        # Beside a missing tile there is no base to show.
        before = seq[0] if (c, t - 1) in kept else "N"
        behind = seq[-1] if (c, t + 1) in kept else "N"
        assert got[(c, t)] == (a, before + seq[1:-1] + behind)
    assert set(got) == kept


def test_tiles_off_the_grid_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("c", 0, 3, "NACGTN")], "chrom string, tile bigint, tile_start bigint, seq string")
    with pytest.raises(Exception, match="does not lie on a grid"):
        sequence.write_sequence_tiles(df, str(tmp_path / "x"), 8)


def test_metrics_are_observed_in_the_same_pass(spark, tmp_path):
    looked = spark.sparkContext.accumulator(0)
    df = spark.range(100).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("v"))

    def look(batches):
        for batch in batches:
            looked.add(len(batch))
            yield batch

    once = df.mapInPandas(look, "id bigint, v double")
    found = sinks.write_table(once, str(tmp_path / "t"), {"n": F.count("*"), "n_v": F.count("v"), "most": F.max("v")}, tsv=False)
    assert found == {"n": 100, "n_v": 85, "most": 99.0} and looked.value == 100
    assert spark.read.parquet(str(tmp_path / "t/metrics")).first().asDict() == found
    empty = sinks.write_table(df.limit(0), str(tmp_path / "e"), {"n": F.count("*"), "most": F.max("v")})
    assert empty == {"n": 0, "most": None}


def test_truncated_sequence_raises(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c\nACGT\n")
    (tmp_path / "g.fa.fai").write_text("c\t40\t3\t10\t11\n")
    with pytest.raises(Exception, match="expected 40 bases"):
        sequence.read_sequence_tiles(spark, str(tmp_path / "g.fa"), 64).collect()


def test_bed_bedgraph_depth(spark, tmp_path):
    (tmp_path / "x.bed").write_text("track a\n#c\nc\t1\t5\nc\t7\t7\n\n")
    (tmp_path / "x.bg").write_text("c\t0\t3\t2.0\nc\t3\t3\t9\nc\t3\t8\t0\n")
    (tmp_path / "x.depth").write_text("c\t1\t4\nc\t2\t0\nd\t1\t7\n")
    assert [tuple(r) for r in tables.read_bed(spark, str(tmp_path / "x.bed")).collect()] == [("c", 1, 5)]
    assert [tuple(r) for r in tables.read_bedgraph(spark, str(tmp_path / "x.bg")).collect()] == [("c", 0, 3, 2), ("c", 3, 8, 0)]
    assert [tuple(r) for r in tables.read_depth(spark, str(tmp_path / "x.depth"), "c").collect()] == [("c", 1, 4)]
    assert tables.read_depth(spark, str(tmp_path / "x.depth"), covered_only=False).count() == 3


def test_gff_tree(spark, tmp_path):
    rows = [
        "##gff-version 3",
        "c\ts\tgene\t1\t90\t.\t-\t.\tID=g1",
        "c\ts\tmRNA\t1\t90\t.\t-\t.\tID=t1; Parent=g1 ;Note=a=b;",
        "c\ts\tmRNA\t2\t90\t.\t-\t.\tID=t2;Parent=g1;flag;Parent=g1",
        "c\ts\tCDS\t1\t30\t.\t-\t0\tID=x;Parent=t1,t2",
        "c\ts\tCDS\t40\t60\t.\t-\t0\tParent=t1",
    ]
    (tmp_path / "a.gff").write_text("\n".join(rows) + "\n")
    features = tables.read_gff(spark, str(tmp_path / "a.gff"))
    assert features.filter("attrs['ID'] = 't1'").first().attrs == {"ID": "t1", "Parent": "g1", "Note": "a=b"}
    got = sorted((r.gene, r.mrna, r.start, r.stop) for r in tables.coding_parts(features).collect())
    assert got == [("g1", "t1", 1, 30), ("g1", "t1", 40, 60), ("g1", "t2", 1, 30)]


def test_dnm_needs_its_columns(spark, tmp_path):
    good = "chrom\tpos\tref\talt\tchild\tfather\tmother\nc\t5\tA\tC\tk\tf\tm\n"
    (tmp_path / "d.tsv").write_text(good)
    assert tables.read_dnm(spark, str(tmp_path / "d.tsv")).first().pos == 5
    with pytest.raises(ValueError, match="Phased"):
        tables.read_dnm(spark, str(tmp_path / "d.tsv"), ["chrom", "Phased"])


def test_callable_summary_malformed_rows(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("c_1\t10\tind_c_1\nc_1\t11\tind_c_2\nc_1\tx\tind_c_1\nshort\n")
    assert [tuple(r) for r in tables.read_callable_summary(spark, str(tmp_path / "c.tsv")).collect()] == [("c_1", 10, "ind")]
    with pytest.raises(Exception, match="malformed row"):
        tables.read_callable_summary(spark, str(tmp_path / "c.tsv"), strict=True).collect()


def test_pair_table_by_header(spark, tmp_path):
    (tmp_path / "k.txt").write_text("  FID1 ID1  ID2 Kinship\n 0  a  b  0.25\n 0 c d NA\n")
    wanted = {"id1": ("ID1", "string"), "id2": ("ID2", "string"), "kinship": ("Kinship", "double"), "z0": ("Z0", "double")}
    got = [tuple(r) for r in tables.read_pairs(spark, str(tmp_path / "k.txt"), wanted).collect()]
    assert got == [("a", "b", 0.25, None), ("c", "d", None, None)]


def test_union_of_files_with_provenance(spark, tmp_path):
    for name in ("ABC_family1_S1_c_1", "ABC_family1_S2_c_2"):
        (tmp_path / f"{name}_sites.vcf").write_text("x\ny\n")
    got = tables.union_files(spark, str(tmp_path / "*_sites.vcf"), r"^(.*_S\d+)_(c_\d+)_sites", ["ind", "chrom"])
    assert sorted((r.ind, r.chrom, r.n) for r in got.groupBy("ind", "chrom").agg(F.count("*").alias("n")).collect()) == [
        ("ABC_family1_S1", "c_1", 2), ("ABC_family1_S2", "c_2", 2),
    ]
    with pytest.raises(Exception):
        tables.union_files(spark, str(tmp_path / "*.none"), "x", ["a"]).collect()


def test_write_partitioned_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("c_1" if i % 3 else "c_2", i) for i in range(90)], "chrom string, pos int")
    path = str(tmp_path / "out")
    sinks.write_partitioned(df, path, files_per_value=4)
    back = spark.read.parquet(path)
    assert back.filter("chrom = 'c_2'").count() == 30 and back.count() == 90
    table, metrics = sinks.with_metrics(df, {"n": F.count("*"), "last": F.max("pos")})
    sinks.write_table(table, str(tmp_path / "t"), metrics)
    assert spark.read.csv(str(tmp_path / "t/metrics"), sep="\t", header=True).first().last == "89"
    assert spark.read.csv(str(tmp_path / "t/table"), sep="\t", header=True).count() == 90


def test_species_dims(spark):
    config = {
        "species": {"A": {"sociality": "social", "x_chromosomes": ["a_X1"], "exclude_trios": ["k"]}, "B": {"sociality": "subsocial"}},
        "groups": {"all": ["A", "B"], "social": ["A"]},
        "sister_pairs": [["B", "A"]],
    }
    got = dims.species_dims(spark, config)
    assert [(r.species, r.leaf_order) for r in got["species"].orderBy("leaf_order").collect()] == [("A", 0), ("B", 1)]
    assert got["groups"].count() == 3 and got["sister_pairs"].first().first == "B" and got["excluded_trios"].count() == 1
    with pytest.raises(ValueError, match="unknown species: Z"):
        dims.species_dims(spark, {"species": {}, "groups": {"g": ["Z"]}})
