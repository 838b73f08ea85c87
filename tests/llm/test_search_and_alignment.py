"""Substring dedup, token alignment and ranked search against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers

from kindred.llm import alignment, ranked, substrings
from kindred.llm.fm_index import FMIndex
from kindred.llm.queries import TOKENS_A, TOKENS_B

SCHEMA = "doc_id bigint, text string"
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
ODD = [
    (1, "a  b"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "<|endoftext|> hi <s> <0x41> ▁x"),
    (6, "café \U0001f600 ok \x00 end"),
    (None, "no id but words"),
    (8, "same same"),
    (8, "same same"),
    (9, "word " * 3000),
    (10, THUE),
    (11, THUE.translate({97: "b", 98: "a"})),
]


def with_clashes(spark, rows):
    """The rows beside columns named like the operators' own."""
    extra = ["id", "t", "h", "n", "hot", "candidates", "found", "pairs", "times", "pair", "n_a", "rank", "score", "number", "part"]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"map('x', 1) AS {x}" for x in extra])


# --- substring dedup ---------------------------------------------------------------------


def kept_words(rows, words):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for j in range(len(w) - words + 1):
            if seen[tuple(w[j : j + words])] > 1:
                gone.update(range(j, j + words))
        left = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, words, n=60):
    """Texts over few words, with shared passages, copies and runs of one word."""
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(words - 2, 3 * words))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 2 * words)))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), rng.choice(shared))
        if rng.random() < 0.1:
            parts.append("zz " * rng.randint(1, 3 * words))
        rows.append((i, "  ".join(parts)))
    return rows + [(n, rows[0][1]), (n, rows[0][1]), (None, rows[1][1])]


@pytest.mark.parametrize("words,hot", [(2, 2000), (5, 2000), (5, 3), (35, 2000), (35, 1), (70, 2000)])
def test_dedup_by_brute_force(spark, monkeypatch, words, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_PIECES", 40)
    rows = passages(words, words) + ODD
    got = substrings.dedup(with_clashes(spark, rows), words=words)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == kept_words(rows, words)


def test_dedup_does_not_depend_on_partitions(spark):
    rows = passages(3, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, substrings.dedup(frame.coalesce(1), words=6).collect()), key=str)
    assert one == sorted(map(tuple, substrings.dedup(frame.repartition(7), words=6).collect()), key=str)


def test_dedup_without_rows_or_repeats(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substrings.dedup_report(empty).collect() == []
    rows = [(1, " ".join(f"w{i}" for i in range(500))), (2, "short")]
    assert [r["n_removed"] for r in substrings.dedup_report(spark.createDataFrame(rows, SCHEMA)).collect()] == [0, 0]
    with pytest.raises(ValueError):
        substrings.dedup(empty, words=71)


def test_index_by_brute_force():
    rng = np.random.default_rng(7)
    for trial in range(60):
        sigma = int(rng.integers(2, 70))
        parts = [rng.integers(1, min(sigma, 4) if trial % 2 else sigma, size=int(rng.integers(0, 20))) for _ in range(int(rng.integers(1, 9)))]
        symbols = np.concatenate([np.r_[p, 0] for p in parts]).astype(np.int64)
        length = np.array([len(p) for p in parts])
        start = np.cumsum(length + 1) - length - 1
        got = FMIndex(symbols, sigma).matching_statistics(symbols, start, length)
        runs = Counter(tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1))
        for p, s in zip(parts, start):
            for i in range(len(p)):
                want = max((j - i for j in range(i + 1, len(p) + 1) if runs[tuple(p[i:j])] > 1), default=0)
                assert got[s + i] == want


# --- token alignment ---------------------------------------------------------------------


def aligned_rows(rows):
    a = tokenizers.Tokenizer.from_file(TOKENS_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=TOKENS_B)
    bytes_a, bytes_b = alignment.bytes_of_a(TOKENS_A), alignment.bytes_of_b(b)
    counts, found = Counter(), []
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[x] for x in ids_a) != whole or b"".join(bytes_b[x] for x in ids_b) != whole:
            found.append((i, None))
            continue
        ends = []
        for ids, own in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, place = 0, {}
            for j, x in enumerate(ids):
                at += len(own[x])
                place[at] = j
            ends.append(place)
        from_a = from_b = 0
        groups, links = [], []
        for e in sorted(set(ends[0]) & set(ends[1])):
            to_a, to_b = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, ids_a[from_a:to_a])) + "|" + ",".join(map(str, ids_b[from_b:to_b])))
            links.append((ids_a[to_a - 1], ids_b[to_b - 1]))
            from_a, from_b = to_a, to_b
        counts.update(links)
        found.append((i, (len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = x[2]
            rated = sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)
            out.append((i, x[0], x[1], len(links), len(links), *rated, x[3]))
    return sorted(out, key=str)


def test_alignment_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + ODD
    got = alignment.alignment_report(spark, with_clashes(spark, rows).repartition(5), TOKENS_A, TOKENS_B)
    assert sorted(map(tuple, got.collect()), key=str) == aligned_rows(rows)


def test_both_ways_to_encode_agree(tmp_path):
    import json

    with open(TOKENS_A, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["ignore_merges"] = True  # not plain any more, and without effect here
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    signs = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}b {c}1 {c}{c} .{c}" for c in signs] + [" " + (t or "") for _, t in ODD]
    assert alignment.encoder_a(TOKENS_A)(texts) == alignment.encoder_a(str(other))(texts)


def test_alignment_without_rows_or_tokens(spark):
    assert alignment.alignment_report(spark, spark.createDataFrame([], SCHEMA), TOKENS_A, TOKENS_B).collect() == []
    rows = [(1, None), (2, ""), (3, "▁")]
    got = alignment.alignment_report(spark, spark.createDataFrame(rows, SCHEMA), TOKENS_A, TOKENS_B).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


# --- ranked search -----------------------------------------------------------------------


def ranked_rows(docs, items, k=10):
    def terms(text):
        lower = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower))

    bags = [(i, terms(t)) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            score = 0
            for x, times in terms(text).items():
                if x in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // total
                    score += times * w * ((1000000000 * bag[x]) // (1000 * bag[x] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def bags_of_words(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("postings,at_once,item_bytes", [(500_000, 16, 1 << 22), (50, 1, 1 << 22), (900, 3, 200)])
def test_search_by_brute_force(spark, monkeypatch, postings, at_once, item_bytes):
    monkeypatch.setattr(ranked, "POSTINGS", postings)
    monkeypatch.setattr(ranked, "AT_ONCE", at_once)
    rows = bags_of_words(1, 300) + ODD + [(7, "w1 w2 w3")] * 30
    items = [(i, t) for i, t in bags_of_words(2, 12)] + [
        (50, None), (51, ""), (52, "nowhere"), (None, "W1 w59 W59 café"), (53, "word"), (53, "word"), (54, "w1-w2_w3")
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id", "2 AS score", "3 AS rank")
    got = ranked.search(with_clashes(spark, rows).repartition(4), benchmark, item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked_rows(rows, items)


def test_search_scores_few_documents():
    """A rare phrase is found without scoring every document that shares a common word with it."""
    rng = np.random.default_rng(3)
    n = 4000
    doc = np.r_[np.arange(n), [17, 1234, 3999]]
    term = np.r_[np.zeros(n, int), [1, 1, 1]]
    tf = np.r_[rng.integers(1, 4, n), [1, 1, 1]]
    lists = ranked.Postings(term, doc, tf, np.full(n, 50), n, 50 * n, np.array([1, 7000]))
    best = []
    scored = lists.search(np.array([0, 1]), np.array([1, 1]), list(range(n)), best, 3)
    assert sorted(x[2] for x in best) == [17, 1234, 3999]
    assert scored < 50


def test_search_without_rows(spark):
    no_docs, no_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id bigint, text string")
    docs, items = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    for d, i in ((no_docs, items), (docs, no_items), (no_docs, no_items)):
        assert ranked.search_report(d, i).collect() == []
