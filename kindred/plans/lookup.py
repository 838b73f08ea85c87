"""Joins to lookup tables whose size is checked before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(
    dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Whether a table is within both bounds; at most ``max_rows + 1`` rows are looked at."""
    size = dim.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct(*dim.columns))).alias("b"))
    n, total = size.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= max_rows and total <= max_bytes


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = 16,
) -> DataFrame:
    """Join a large table to a lookup table unique on ``on``.

    The lookup is measured first.  Within the bounds it is broadcast, so a hot key costs
    nothing.  Beyond them the facts are salted by a hash of the row and the lookup is
    repeated per salt, so a key with a third of all rows is spread over ``salts`` tasks.
    Use it for lookup tables that are inputs; a lookup derived from the facts is joined
    plainly and left to adaptive execution, which sees its real size.
    """
    if fits_broadcast(dim, max_rows):
        return facts.join(F.broadcast(dim), on, how)
    hashed = [c for c, t in facts.dtypes if not t.startswith("map")]
    salted = facts.withColumn("__salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    copies = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
