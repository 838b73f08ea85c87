"""Order MinHash: fingerprints whose likeness follows the edit distance of texts.

A text's words (cut after 16 characters) give its k-mers of ``K`` words; a shorter text is one
k-mer.  A k-mer is numbered by its occurrence.  Each of ``SLOTS`` slots selects, over all numbered
k-mers of the text, the ``PICK`` that are least by the slot's own hash (all, if there are fewer),
puts them back in the order in which they stand in the text, and hashes the tuple.  Moving or
editing words changes which k-mers are selected, or their order, and so the slot.  Likeness is the
share of equal slots among those that either text fills; two texts without words are alike (1).

The slots' hashes are those of SuperMinHash: a k-mer visits the slots in an order of its own, one
a round, and its hash in a slot is the round plus a fresh fraction.  So a slot's hashes are uniform
and independent between k-mers, and k-mers of later rounds need no look once every slot has
``PICK`` of earlier ones.  A text whose first rounds leave a slot short goes through all rounds.

Null and empty texts fill no slot.  Equal texts have equal fingerprints.  Rows that repeat wholly
follow each other, no rows give no rows, further columns are left out of the report and pass
through ``with_slots`` (a column named like the new one is replaced).  Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import stored

K, SLOTS, PICK = 2, 32, 2
SLOT_BITS = 5
#: A k-mer's hash keeps the upper 40 bits; the lower 24 hold its position in the text.
PLACE_BITS = 24
#: Numbered k-mers that the first rounds deal out at least: 16 a slot on average.
DEALT = 16 * SLOTS
#: Ranges of ids in which neighbours are found; one row per range is carried across them.
RANGES = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def numbered(ordered: Column) -> Column:
    """Occurrence number of each k-mer of a sorted array of hash and place."""
    n = F.size(ordered)

    def new(x: Column, i: Column) -> Column:
        before = F.shiftrightunsigned(F.get(ordered, i - 1), PLACE_BITS)
        return F.coalesce(F.shiftrightunsigned(x, PLACE_BITS) != before, F.lit(True))

    marks = F.transform(ordered, lambda x, i: F.when(new(x, i), i).otherwise(F.lit(-1)))
    runs = F.filter(marks, lambda i: i >= 0)
    return bound(
        runs,
        lambda r: F.flatten(F.transform(r, lambda at, j: F.sequence(F.lit(0), F.coalesce(F.get(r, j + 1), n) - at - 1))),
    )


def dealt(hashes: Column, rounds: Column) -> Column:
    """Slot, round, fraction and index of each k-mer in the first rounds, as sorted integers.

    The upper bits of a k-mer's hash give its first slot and an odd step to the next.
    """
    fraction = ((1 << 64 - 2 * SLOT_BITS - PLACE_BITS) - 1) << PLACE_BITS
    first = F.transform(
        hashes,
        lambda x, i: x.bitwiseAND(long((-1 << 64 - SLOT_BITS) | fraction)).bitwiseOR(i.cast("bigint")),
    )

    def later(r: Column) -> Column:
        def item(x: Column, i: Column) -> Column:
            start = F.shiftrightunsigned(x, 64 - SLOT_BITS)
            step = F.shiftrightunsigned(x, 64 - 2 * SLOT_BITS).bitwiseAND(long(SLOTS - 1)).bitwiseOR(long(1))
            slot = (start + r * step).bitwiseAND(long(SLOTS - 1))
            own = F.shiftrightunsigned(F.xxhash64(x, r), 2 * SLOT_BITS).bitwiseAND(long(fraction))
            upper = F.shiftleft(slot, 64 - SLOT_BITS).bitwiseOR(F.shiftleft(r.cast("bigint"), 64 - 2 * SLOT_BITS))
            return upper.bitwiseOR(own).bitwiseOR(i.cast("bigint"))

        return F.transform(hashes, item)

    further = F.flatten(F.transform(F.sequence(F.lit(1), rounds - 1), later))
    return F.sort_array(F.when(rounds > 1, F.concat(first, further)).otherwise(first))


def picked(items: Column) -> Column:
    """The PICK least items of each slot."""

    def slot(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - SLOT_BITS)

    return F.filter(items, lambda x, i: F.coalesce(slot(F.get(items, i - PICK)) != slot(x), F.lit(True)))


def with_slots(docs: DataFrame, text: Column, out: str) -> DataFrame:
    """Add the slots of ``text``: an array of SLOTS hashes, null for a text without words."""
    own = [c for c in docs.columns if c != out]
    pieces = docs.withColumn("__w", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S{1,16}"), F.lit(0)))
    place = long((1 << PLACE_BITS) - 1)
    top = F.bitwise_not(place)
    last = F.greatest(F.size("__w") - K, F.lit(0))
    kmers = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(K)]).bitwiseAND(top).bitwiseOR(
            i.cast("bigint").bitwiseAND(place)
        ),
    )

    def slots(ordered: Column, hashes: Column) -> Column:
        n = F.size(hashes)
        rounds = F.least(F.lit(SLOTS), F.ceil(F.lit(DEALT) / n).cast("int"))
        whole = F.lit(SLOTS) * F.least(F.lit(PICK), n)

        def chosen(rounds: Column) -> Column:
            return bound(dealt(hashes, rounds), picked)

        def tuples(items: Column) -> Column:
            def tuple_hash(j: Column) -> Column:
                inside = F.slice(items, j * F.least(F.lit(PICK), n) + 1, F.least(F.lit(PICK), n))
                at = F.transform(inside, lambda x: x.bitwiseAND(place).cast("int"))
                by_place = F.array_sort(
                    F.transform(
                        at, lambda i: F.struct(F.get(ordered, i).bitwiseAND(place).alias("at"), F.get(hashes, i).alias("h"))
                    )
                )
                value = F.aggregate(by_place, long(0), lambda a, x: F.xxhash64(a, x["h"]))
                return value.bitwiseAND(long(0xFFFFFFFF))

            return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), tuple_hash)

        every = bound(chosen(rounds), lambda x: F.when(F.size(x) == whole, x).otherwise(chosen(F.lit(SLOTS))))
        return bound(every, tuples)

    def of(ordered: Column) -> Column:
        hashes = F.zip_with(ordered, numbered(ordered), lambda x, o: F.xxhash64(x.bitwiseAND(top), o))
        return bound(hashes, lambda h: slots(ordered, h))

    none = F.array_repeat(F.lit(None).cast("bigint"), SLOTS)
    return pieces.select(*own, F.when(F.size("__w") > 0, bound(F.sort_array(kmers), of)).otherwise(none).alias(out))


def written(slots: str) -> Column:
    """A fingerprint as text: eight hex digits per slot, dashes for an empty one."""
    return F.array_join(
        F.transform(slots, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 8, "0")), F.lit("-" * 8))), ""
    )


def likeness(a: str, b: str) -> Column:
    """Share of equal slots among those that either fingerprint fills."""
    places = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    filled = F.size(F.filter(places, lambda i: F.get(a, i).isNotNull() | F.get(b, i).isNotNull()))
    equal = F.size(F.filter(places, lambda i: F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False))))
    return F.when(filled == 0, 1.0).otherwise(equal / filled)


KEY = ["k_id", "k_null", "k_text"]


def keyed(docs: DataFrame) -> DataFrame:
    """Add a row's key: its id (with a mark for null) and a hash of its text."""
    return docs.select(
        "*",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")).alias("k_id"),
        F.col("doc_id").isNull().alias("k_null"),
        F.xxhash64("text").alias("k_text"),
    )


def neighbours(docs: DataFrame) -> DataFrame:
    """Per distinct row: how often it stands there, and key and length of the row before it in the ring.

    The ring follows descending ids (null ids last, equal ids by text hash) and closes from the
    last row to the first.  Only keys and lengths are ordered: in ranges of ids, with the ends of
    each range carried across at most RANGES + 1 rows.
    """
    rows = keyed(docs).select(*KEY, F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    thin = stored(rows.groupBy(*KEY).agg(F.max("n").alias("n"), F.count("*").alias("copies")))
    shares = [i / RANGES for i in range(1, RANGES)]
    cuts = thin.filter(~F.col("k_null")).agg(F.percentile_approx("k_id", shares, 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    edges = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    above = F.size(F.filter(edges, lambda c: c <= F.col("k_id")))
    # Ranges are numbered in the ring's order: from the highest ids down, null ids last.
    ranged = thin.withColumn("range", F.when(F.col("k_null"), len(cuts) + 1).otherwise(len(cuts) - above))
    order = [F.asc("range"), F.asc("k_null"), F.desc("k_id"), F.asc("k_text")]
    me = F.struct(*KEY, "n")
    local = W.partitionBy("range").orderBy(*order[1:])
    linked = ranged.withColumn("prev", F.lag(me).over(local))
    rank = F.struct("k_null", (-F.col("k_id")).alias("d"), "k_text")
    ends = ranged.groupBy("range").agg(F.max_by(me, rank).alias("last"))  # RANGES + 1 rows at most
    ring = W.orderBy("range")
    carry = ends.select(
        "range", F.coalesce(F.lag("last").over(ring), F.last("last").over(ring.rowsBetween(0, W.unboundedFollowing))).alias("carry")
    )
    closed = linked.join(F.broadcast(carry), "range").withColumn("prev", F.coalesce("prev", "carry"))
    return closed.select(*KEY, "copies", F.col("prev").alias("prev"))


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last floor(n/3) characters replaced by the first as many (or all) of
    the next document's.  Texts are shuffled once by key; a row then sends the head that the row
    before it needs, and its slots.
    """
    rows = keyed(docs.select("doc_id", "text"))
    marked = with_slots(rows, F.col("text"), "slots")
    copy = F.row_number().over(W.partitionBy(*KEY).orderBy("k_id"))
    joined = marked.join(neighbours(docs), KEY).withColumn("copy", copy)
    heads = joined.filter("copy = 1").select(
        F.col("prev.k_id").alias("k_id"),
        F.col("prev.k_null").alias("k_null"),
        F.col("prev.k_text").alias("k_text"),
        F.col("doc_id").alias("next_id"),
        F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.floor(F.col("prev.n") / 3).cast("int")).alias("head"),
        F.col("slots").alias("next_slots"),
    )
    n = F.coalesce(F.char_length("text"), F.lit(0))
    cut = F.floor(n / 3).cast("int")
    own = F.col("copy") < F.col("copies")  # the next row is another copy of this one
    body = F.coalesce("text", F.lit(""))
    paired = joined.join(heads, KEY).select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        "slots",
        F.when(own, F.col("slots")).otherwise(F.col("next_slots")).alias("next_slots"),
        F.when(own, F.col("doc_id")).otherwise(F.col("next_id")).alias("next_id"),
        F.concat(
            F.substring(body, F.lit(1), n - cut), F.when(own, F.substring(body, F.lit(1), cut)).otherwise(F.col("head"))
        ).alias("edited"),
    )
    both = with_slots(paired, F.col("edited"), "edited_slots")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("slots").alias("fingerprint"),
        written("edited_slots").alias("edited_fingerprint"),
        likeness("slots", "edited_slots").alias("near_edited"),
        likeness("slots", "next_slots").alias("near_next"),
        "next_id",
    )
