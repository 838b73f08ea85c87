"""Hash draws: random numbers that depend on their labels only.

A draw is a prefix of an MD5 digest over (seed, label, ...), so replicates do not depend on
partitioning, row order or retries, and any SQL engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 12
RANGE = 16**HEX_DIGITS


def hash_int(*labels) -> Column:
    """Uniform integer in [0, 16**12) from the labels joined by ':'."""
    parts = [c.cast("string") if isinstance(c, Column) else F.lit(str(c)) for c in labels]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")


def uniform(*labels) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(*labels) / F.lit(float(RANGE))


def draw_index(n: Column, *labels) -> Column:
    """Uniform index in [0, n)."""
    return F.pmod(hash_int(*labels), n.cast("bigint"))


def duck_hash_int(*labels: str) -> str:
    """The same draw as SQL text for the oracle; labels are SQL expressions."""
    joined = " || ':' || ".join(f"CAST({x} AS VARCHAR)" for x in labels)
    return f"CAST('0x' || substr(md5({joined}), 1, {HEX_DIGITS}) AS BIGINT)"


def duck_uniform(*labels: str) -> str:
    return f"({duck_hash_int(*labels)} / {float(RANGE)})"
