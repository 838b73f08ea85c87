"""Filters beside columns of any name, texts made to collide, and rare labels."""

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import byte_pairs, common, decontaminate, jaccard, language, queries, secrets_scan, urls

#: Names that the stages use for columns of their own.
INTERNAL = [
    "id", "no_id", "s", "n", "set_id", "copies", "nth", "t", "h", "k1", "k2", "own_k1", "item_id", "similarity", "spans",
    "base_spans", "candidates", "language", "language_p", "language_ok", "sh", "words", "cluster", "chunks", "c", "r",
    "sig", "key", "members", "word", "bit", "want", "none", "first_set", "component", "label", "url", "host",
]


def thue(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def other(x):
    return x.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_pieces_made_to_collide_keep_their_ids(spark, n):
    """Strings that agree in every polynomial modulo 2^64 are different pieces."""
    texts = [thue(n), other(thue(n)), "x " + thue(n) + " " + other(thue(n))]
    ranks = byte_pairs.read_ranks(queries.RANKS)
    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocab = byte_pairs.vocabulary(spark, queries.RANKS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    for r in byte_pairs.encode(docs, vocab).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(r["text"])


def test_words_made_to_collide_do_not_link(spark):
    rows = [(1, thue(2048)), (2, other(thue(2048))), (3, f"a {thue(1024)} b c d"), (4, f"a {other(thue(1024))} b c d"), (5, thue(2048))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_hashes_of_ranges():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    data[3000:3100] = data[100:200]
    starts = rng.integers(0, 4900, 400)
    ends = starts + rng.integers(0, 100, 400)
    for hashes in (common.PrimeHash(2), common.RangeHash(2)):
        h = hashes(data, starts, ends)
        assert hashes(data, np.array([3000]), np.array([3100])) == hashes(data, np.array([100]), np.array([200]))
        by_bytes = {}
        for a, b, x in zip(starts, ends, h):
            assert by_bytes.setdefault(data[a:b].tobytes(), x) == x
        assert len(set(by_bytes.values())) == len(by_bytes)


def test_id_filter_passes_all_its_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 12)
    ids = spark.range(300).selectExpr("xxhash64(id) AS h")
    here = common.id_filter(ids, "h")
    passed = {r["id"] for r in spark.range(3000).filter(here(F.xxhash64("id"))).collect()}
    assert set(range(300)) <= passed and len(passed) < 700


LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(LOREM)
    rows = [
        (1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (3, text + " phi", "en", "b"), (None, text[::-1], "en", "b"),
        (5, None, None, None), (6, "", "en", "a"), (7, "password=abcdefgh12345 and more words here", "en", "c"),
        (8, " ".join(LOREM[::-1]), "en", "c"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr(
        "*", "cast(length(text) as int) AS n_chars"
    )


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_beside_columns_of_any_name(spark, docs, stage, tmp_path):
    """A stage keeps the same rows, in all their columns, whatever further columns are called."""
    spark.createDataFrame([(1, " ".join(LOREM[::-1])[:60])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    plain = run(spark, docs, str(tmp_path))
    own = docs.columns
    assert plain.columns == own
    extra = [x for x in INTERNAL if x not in own]
    wide = docs.selectExpr("*", *[f"concat('{x}', doc_id) AS `{x}`" for x in extra], "array(map('k', 1)) AS maps", "1 AS `a.b`")
    kept = run(spark, wide, str(tmp_path))
    assert kept.columns == wide.columns
    assert rows_of(kept, own) == rows_of(plain, own)
    for r in kept.collect():
        assert all(r[x] == (None if r["doc_id"] is None else f"{x}{r['doc_id']}") for x in extra)


def test_pipeline_on_a_small_table(spark, docs, tmp_path):
    """What each stage does to rows that are known: copies, a benchmark passage, a secret, nulls."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(LOREM[::-1]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((r["doc_id"] for r in got), key=str)
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 8 not in ids and 7 in ids
    kept = corpus_pipeline.without_secrets(spark, docs, str(tmp_path)).filter("doc_id = 7").first()
    assert kept["text"] == "[secret] and more words here" and kept["n_chars"] == len(kept["text"])


def test_urls_beside_columns_of_any_name(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    plain = {r["page_id"]: tuple(r)[1:] for r in urls.url_report(pages).collect()}
    names = ["length", "suffix", "top", "depth", "ruled", "label", "__v", "entropy", "labels"]
    wide = pages.selectExpr("*", *[f"'{x}' AS `{x}`" for x in names], "'mine' AS host")
    got = urls.judge(wide).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["p_block"]) for r in got} == plain
    assert all(r[x] == x for r in got for x in names)


def test_a_rare_label_is_learned(spark, monkeypatch):
    """One blocked host among very many allowed ones still trains the trees."""
    monkeypatch.setattr(urls, "TRAIN_ROWS", 60)
    rows = [(i, f"http://a{i}.com/x{i}") for i in range(2000)] + [(9000 + i, f"http://shop{i}.net/fr/buy?a={i}&b=2") for i in range(3)]
    rows += [(9900, "http://shop77.net/xx/buy?a=1&b=2"), (9901, None), (9902, "no address")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got[9000]["verdict"] == "block" and got[5]["verdict"] == "allow"
    assert got[9900]["p_block"] > 0.5 and got[9900]["verdict"] == "block"
    one = urls.judge(spark.createDataFrame(rows[:5], "page_id bigint, url string")).collect()
    assert {r["verdict"] for r in one} == {"allow"}


def test_similarities_without_a_scheme_are_refused():
    for percent in (49, 95, 99, 100):
        with pytest.raises(ValueError):
            jaccard.schemes(percent)


def test_filters_without_rows(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert jaccard.keep_first(none).count() == 0
    assert decontaminate.keep_clean(none, items).count() == 0
    assert secrets_scan.redact(none).count() == 0
    assert language.keep_known(none).count() == 0
