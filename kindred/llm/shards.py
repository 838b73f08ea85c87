"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows get global numbers 0 .. n-1 in the order of a 64-bit hash of (doc_id, text), then doc_id,
size and checksum: an order that depends on the rows alone.  The numbers are made without a
global sort: a row's bucket is the top bits of its hash, a window numbers the rows of a bucket,
and one total per bucket is carried across the fixed number of buckets.

A Feistel network on the pair (number div b, number mod b) permutes a x b >= n numbers.  The few
results of n or more are walked on along their cycle until they fall below n, so 0 .. n-1 is
permuted.  The permuted number p gives the shard (p mod shards) and the slot (p div shards):
anyone can compute a row's place from its number, and its number from its place.

Shard sizes differ by one row at most (law ``rows``).  Null ids and null texts are values like
any other; rows that repeat wholly are interchangeable and get different slots; no rows give
no rows.  Further columns are left out; size and checksum come from id and text only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import stored

#: Buckets of the row order; one total each is carried, so the carry has a fixed size.
BUCKET_BITS = 13
RUN = 4096
ROUNDS = 8


def domain(n: int) -> tuple[int, int]:
    """a x b >= n with the fewest superfluous numbers among near-square choices of a."""
    root = max(1, isqrt(max(n, 1)))
    least = max(1, root - min(root // 4, 4095))
    return min(((a, -(-n // a)) for a in range(least, root + 1)), key=lambda ab: (ab[0] * ab[1], -ab[0]))


def permuted(x: Column, n: int, seed: int) -> Column:
    """A permutation of 0 .. n-1 applied to ``x``."""
    a, b = domain(n)
    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def once(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("bigint").alias("l"), (v % b).cast("bigint").alias("r"))

        def turn(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), F.lit(a)), F.lit(a)).cast("bigint")
            even = F.struct(left.alias("l"), s["r"].alias("r"))
            right = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], i, F.lit(seed)), F.lit(b)), F.lit(b)).cast("bigint")
            odd = F.struct(s["l"].alias("l"), right.alias("r"))
            return F.when(i % 2 == 0, even).otherwise(odd)

        return F.aggregate(turns, start, turn, lambda s: s["l"] * b + s["r"])

    first = once(x)
    spare = a * b - n
    if spare == 0:
        return first
    # A walk that starts below n meets each of the spare numbers once at most.
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(spare)), first, lambda v, _: F.when(v < n, v).otherwise(once(v))
    )


def row_numbers(rows: DataFrame, order: str, out: str) -> tuple[DataFrame, int]:
    """Add 0-based numbers in the order of a 64-bit hash column, then all columns; also the number of rows.

    Equal rows are counted before the shuffle and dealt out again in runs of RUN after it, so a
    row that repeats without end is one row in its bucket.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    dealt = counted.withColumn("__bucket", F.shiftrightunsigned(order, 64 - BUCKET_BITS).cast("int"))
    totals = dealt.groupBy("__bucket").agg(F.sum("__n").alias("__n")).collect()  # 2 ** BUCKET_BITS rows at most
    upto, carry = 0, []
    for key, count in sorted((r["__bucket"], r["__n"]) for r in totals):
        carry.append((key, upto))
        upto += count
    before = rows.sparkSession.createDataFrame(carry, "__bucket int, __before bigint")
    inside = W.partitionBy("__bucket").orderBy(order, *[c for c in columns if c != order])
    upto_row = F.sum("__n").over(inside.rowsBetween(W.unboundedPreceding, 0))
    first = dealt.withColumn("__in", upto_row - F.col("__n")).join(F.broadcast(before), "__bucket")
    runs = first.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(RUN))))
    last = F.least(F.col("__n") - 1, F.col("__run") + RUN - 1)
    each = runs.withColumn("__copy", F.explode(F.sequence(F.col("__run"), last)))
    return each.select(*columns, (F.col("__before") + F.col("__in") + F.col("__copy")).alias(out)), upto


def shard(docs: DataFrame, shards: int, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, size (UTF-8 bytes and 8), checksum of the text, row number, shard and slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    thin = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 8).cast("bigint").alias("size"),
            F.crc32(body.cast("binary")).cast("bigint").alias("text_crc32"),
            F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)).alias("__order"),
        )
    )
    numbered, n = row_numbers(thin, "__order", "row_number")
    place = numbered.withColumn("__p", permuted(F.col("row_number"), n, seed) if n else F.col("row_number"))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("__p") % shards).cast("int").alias("shard"),
        F.floor(F.col("__p") / shards).cast("bigint").alias("slot"),
    )


def shard_report(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Every document's shard and slot under the law ``rows``: counts differ by one at most."""
    return shard(docs, shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
