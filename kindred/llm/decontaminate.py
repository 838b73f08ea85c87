"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, verification.

Words are runs of letters and digits in lower case; shingles are ``K`` consecutive words, weighted
by how often they occur.  For an item of n words, windows of n words of a document (all of a
shorter one) are compared with it.  A window's 64-bit SimHash is split into BLOCKS blocks; if two
fingerprints differ in at most RADIUS bits, some block differs in at most ``RADIUS // BLOCKS``
bits, so the items are indexed under every block value within that distance and the windows look
up their own values: no fingerprint within the radius is missed.  Candidates within the radius
are verified by the exact weighted Jaccard similarity of the shingles (``LEAST`` or more).

Windows are only formed around anchors, which loses nothing: a window that reaches the
similarity shares a run of consecutive shingles with its item that is at least as long as the
step between the probed shingles (see ``probe_step``).  Everything about a document depends on
its text, so equal texts are handled once, under a 128-bit key.

Items of fewer than K words identify nothing and are not searched.  Null, empty and short
documents have no windows and are clean.  Repeated items are found as often; repeated documents
repeat their finds; empty tables find nothing.  Further columns pass through the filter.
Built-in functions only.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed_rows, stored, unpacked_rows

K, LEAST = 5, 0.8
RADIUS = 19
WIDTHS = (13, 13, 13, 13, 12)
KEY = ["k1", "k2"]


def word_list(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_at(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(K)])


def shingle_list(words: str) -> Column:
    """Hashes of all shingles, in order; none for a text of fewer than K words."""
    w = F.col(words)
    none = F.array().cast("array<bigint>")
    return F.when(
        F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: shingle_at(w, i))
    ).otherwise(none)


def sim_hash(shingles: Column) -> Column:
    """64-bit SimHash: bit b is set if most shingles, counted with repeats, have it set.

    Two bits are counted in one pass, in the halves of a 64-bit integer.
    """
    lanes = F.lit(0x0000000100000001).cast("bigint")
    low = F.lit(0xFFFFFFFF).cast("bigint")
    n = F.size(shingles)

    one = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")

    def pair(fingerprint: Column, j: Column) -> Column:
        def bits(both: Column) -> Column:
            first = F.when(both.bitwiseAND(low) * 2 > n, F.call_function("shiftleft", one, j)).otherwise(none)
            second = F.when(F.shiftrightunsigned(both, 32) * 2 > n, F.call_function("shiftleft", one, j + 32))
            return first.bitwiseOR(F.coalesce(second, none))

        counted = F.aggregate(
            shingles, none, lambda a, h: a + F.call_function("shiftright", h, j).bitwiseAND(lanes), bits
        )
        return fingerprint.bitwiseOR(counted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"), pair)


def block_values(fingerprint: Column) -> list[Column]:
    out, at = [], 0
    for width in WIDTHS:
        out.append(F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).cast("int"))
        at += width
    return out


def masks(width: int, most: int) -> list[int]:
    """All values of ``width`` bits with at most ``most`` bits set."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)]


def probe_step(sizes: list[int], least: float = LEAST) -> int:
    """Step between probed shingles that still meets every window of the given numbers of shingles.

    Of a window of v shingles and an item of m, at least least * (m + v) / (1 + least) are shared.
    What is not shared cuts the window's shared positions into runs; the longest run is at
    least the shared number over the number of runs.
    """
    step = 8
    for m in sizes:
        for v in range(max(1, ceil(least * m - 1e-9)), m + 1):
            shared = ceil(least * (m + v) / (1 + least) - 1e-9)
            if shared <= v:
                step = min(step, -(-shared // (v - shared + 1)))
    return max(1, step)


def prepared_items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), sh (shingle hashes) and fp (SimHash) of every searchable item."""
    listed = benchmark.select(F.col("item_id"), word_list("text").alias("w"))
    items = listed.select("item_id", F.size("w").alias("n"), shingle_list("w").alias("sh")).filter(F.col("n") >= K)
    return stored(items.withColumn("fp", sim_hash(F.col("sh"))))


def text_key() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("key"), "text").alias("k2")]


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle lists: sums of the lesser and the greater counts."""

    def count(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda y: y == x))

    distinct = F.array_distinct(a)
    plain = (F.size(distinct) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    weighted = F.aggregate(distinct, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(weighted)
    return shared / (F.size(a) + F.size(b) - shared)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Per key of a text and item: the best similarity and the first word of the best window."""
    items = prepared_items(benchmark)
    step = probe_step([r["n"] - K + 1 for r in items.select("n").distinct().collect()], least)
    by_shingle = stored(items.select("n", F.explode("sh").alias("h")).distinct())
    texts = docs.select(*text_key(), word_list("text").alias("w"))
    probes = F.transform(
        F.sequence(F.lit(0), F.size("w") - K, F.lit(step)),
        lambda i: F.struct(i.alias("at"), shingle_at(F.col("w"), i).alias("h")),
    )
    probed = texts.filter(F.size("w") >= K).select(*KEY, probes.alias("p"))
    # explode_outer: for explode a filter on the array's size would be pushed below and repeat its making.
    met = probed.select(*KEY, F.explode_outer("p").alias("p")).select(*KEY, "p.at", "p.h").join(by_shingle, "h")
    anchors = stored(met.groupBy(*KEY).agg(F.collect_set(F.struct("n", "at")).alias("anchors")))

    # The texts that have anchors, once each, with all their shingles.
    held = docs.select(*text_key(), "text").join(anchors, KEY).groupBy(*KEY).agg(
        F.first("text").alias("text"), F.first("anchors").alias("anchors")
    )
    held = stored(held.withColumn("w", word_list("text")).select(*KEY, shingle_list("w").alias("sh"), "anchors"))

    def around(a: Column) -> Column:
        last = F.greatest(F.size("sh") + K - 1 - a["n"], F.lit(0))  # last start of a window of n words
        lo = F.least(F.greatest(a["at"] - (a["n"] - K), F.lit(0)), last)
        hi = F.least(a["at"], last)
        return F.transform(
            F.sequence(lo, hi), lambda p: a["n"].cast("bigint") * F.lit(1 << 32).cast("bigint") + p
        )

    starts = F.array_distinct(F.flatten(F.transform("anchors", around)))
    windows = held.select(*KEY, "sh", starts.alias("starts"))
    n_of = F.floor(F.col("s") / (1 << 32)).cast("int")
    at_of = F.col("s").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).cast("int")
    hashed = windows.select(
        *KEY,
        F.explode_outer(
            F.transform(
                "starts",
                lambda s: F.struct(
                    s.alias("s"),
                    sim_hash(
                        F.slice(
                            "sh",
                            s.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).cast("int") + 1,
                            F.floor(s / (1 << 32)).cast("int") - K + 1,
                        )
                    ).alias("fp"),
                ),
            )
        ).alias("x"),
    ).select(*KEY, F.col("x.s").alias("s"), F.col("x.fp").alias("fp"))
    blocks = F.array(*[F.struct(F.lit(i).alias("b"), v.alias("v")) for i, v in enumerate(block_values(F.col("fp")))])
    looked = hashed.select(*KEY, n_of.alias("n"), at_of.alias("at"), "fp", F.explode(blocks).alias("x")).select(
        *KEY, "n", "at", "fp", "x.b", "x.v"
    )
    index = None
    for i, (width, value) in enumerate(zip(WIDTHS, block_values(F.col("fp")), strict=True)):
        near = F.explode(F.array(*[F.lit(m) for m in masks(width, RADIUS // len(WIDTHS))]))
        part = items.select("item_id", "n", F.col("fp").alias("item_fp"), value.alias("v0"), near.alias("m"))
        part = part.select("item_id", "n", "item_fp", F.lit(i).alias("b"), F.col("v0").bitwiseXOR(F.col("m")).alias("v"))
        index = part if index is None else index.unionByName(part)
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    candidates = looked.join(stored(index), ["n", "b", "v"]).filter(close).select(*KEY, "item_id", "n", "at").distinct()
    with_items = candidates.join(items.select("item_id", "n", F.col("sh").alias("item_sh")), ["item_id", "n"])
    by_text = with_items.groupBy(*KEY).agg(F.collect_list(F.struct("item_id", "n", "at", "item_sh")).alias("c"))
    scored = by_text.join(held.select(*KEY, "sh"), KEY).select(
        *KEY,
        F.explode_outer(
            F.filter(
                F.transform(
                    "c",
                    lambda c: F.struct(
                        similarity(F.slice("sh", c["at"] + 1, c["n"] - K + 1), c["item_sh"]).alias("similarity"),
                        (-c["at"]).alias("back"),
                        c["item_id"].alias("item_id"),
                        c["n"].alias("n"),
                    ),
                ),
                lambda c: c["similarity"] >= least,
            )
        ).alias("c"),
    )
    best = scored.filter("c IS NOT NULL").groupBy(*KEY, "c.item_id").agg(F.max("c").alias("best"))
    return stored(
        best.select(*KEY, "item_id", "best.similarity", (-F.col("best.back")).alias("first_word"), F.col("best.n").alias("n_words"))
    )


def find(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of every contaminated document and item."""
    found = contaminated_texts(docs, benchmark, least)
    return docs.select("doc_id", *text_key()).join(found, KEY).drop(*KEY)


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that contain no benchmark item, with their columns."""
    found = contaminated_texts(docs.select("text"), benchmark, least).select(*KEY).distinct()
    marks = [c.alias(f"own_{k}") for c, k in zip([F.xxhash64("text"), F.xxhash64(F.lit("key"), "text")], KEY, strict=True)]
    keyed = packed_rows(docs, "text").select("__row", *marks)
    on = (F.col("own_k1") == F.col("k1")) & (F.col("own_k2") == F.col("k2"))
    return unpacked_rows(keyed.join(found, on, "left_anti"))
