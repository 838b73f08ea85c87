"""Running aggregates that never put a whole key into one task.

A window over ``partitionBy(key)`` sends every row of a key to one task, and a single
chromosome or sample may hold a third of all rows.  Here each key is cut into ordered
buckets.  The window runs inside a bucket, one total per bucket is carried across the
buckets, and the carry is joined back on (key, bucket).  The carry window sees one row per
non-empty bucket, and the join reuses the bucket partitioning of the local window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .cut import cut_lineage

_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def position_bucket(pos: str | Column, width: int) -> Column:
    """Ordered bucket of an integer position: at most ``width`` distinct values each."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(width)).cast("bigint")


def magnitude_bucket(x: str | Column, per_octave: int = 16) -> Column:
    """Ordered bucket of a non-negative double, fine near zero; zero has its own bucket."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > 0, F.floor(F.log2(x) * per_octave).cast("bigint")).otherwise(
        F.lit(-(2**40)).cast("bigint")
    )


def probability_bucket(p: str | Column) -> Column:
    """Ordered bucket of a probability: 1/4096 steps, then octaves inside the first step."""
    p = F.col(p) if isinstance(p, str) else p
    fine = F.floor(p * 4096).cast("bigint")
    return F.when(fine >= 1, fine).otherwise(
        F.least(F.lit(0).cast("bigint"), magnitude_bucket(p, 8))
    )


def signed_bucket(x: str | Column, per_octave: int = 16) -> Column:
    """Ordered bucket of any finite double."""
    x = F.col(x) if isinstance(x, str) else x
    size = F.floor(F.log2(F.abs(x)) * per_octave).cast("bigint") + 40000 * per_octave
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, size).otherwise(-size)


def range_buckets(df: DataFrame, order: str, out: str = "__range") -> DataFrame:
    """Add a bucket that is monotone in any sortable column: the range partition of the row.

    The ranges are sampled, so the rows are stored with their buckets (reliable checkpoint)
    before anything is computed from them.
    """
    return cut_lineage(df.repartitionByRange(F.col(order)).withColumn(out, F.spark_partition_id().cast("bigint")))


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    bucket: Column,
    measures: dict[str, tuple[str, str]],
    reverse: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum``/``min``/``max`` columns per key in the order of ``order``.

    ``measures`` maps an output column to (function, input column).  ``bucket`` must be
    monotone in ``order``.  Rows must be unique on (keys, order): aggregate first.
    ``reverse`` runs from the largest value down; ``inclusive=False`` leaves the current
    row out.
    """
    b = "__bucket"
    rows = df.withColumn(b, bucket)
    direction = F.desc if reverse else F.asc
    last = 0 if inclusive else -1
    local = (
        W.partitionBy(*keys, b)
        .orderBy(direction(order))
        .rowsBetween(W.unboundedPreceding, last)
    )
    carry_window = (
        W.partitionBy(*keys).orderBy(direction(b)).rowsBetween(W.unboundedPreceding, -1)
        if keys
        else W.orderBy(direction(b)).rowsBetween(W.unboundedPreceding, -1)
    )
    totals = rows.groupBy(*keys, b).agg(
        *[_AGG[f](c).alias(f"__t_{out}") for out, (f, c) in measures.items()]
    )
    carry = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(b).alias("__k_bucket"),
        *[
            _AGG[f](f"__t_{out}").over(carry_window).alias(f"__c_{out}")
            for out, (f, _) in measures.items()
        ],
    )
    with_local = rows.select(
        "*", *[_AGG[f](c).over(local).alias(f"__l_{out}") for out, (f, c) in measures.items()]
    )
    on = reduce(
        lambda x, y: x & y,
        [with_local[k].eqNullSafe(carry[f"__k_{k}"]) for k in keys]
        + [with_local[b] == carry["__k_bucket"]],
    )
    joined = with_local.join(carry, on, "left")
    return joined.select(
        *df.columns,
        *[
            _COMBINE[f](F.col(f"__l_{out}"), F.col(f"__c_{out}")).alias(out)
            for out, (f, _) in measures.items()
        ],
    )


def neighbours(
    points: DataFrame, keys: list[str], pos: str, width: int = 65536
) -> DataFrame:
    """Add ``prev_pos`` and ``next_pos`` to rows unique on (keys, pos).

    The points are dealt out by (key, bucket) once.  From that one exchange come the neighbours
    inside a bucket, and one row per bucket with its first and last position; a window over
    those rows carries the last position from the left and the first from the right, and comes
    back with the bucket.
    """
    b = "__bucket"
    dealt = points.withColumn(b, position_bucket(pos, width)).repartition(*keys, b)
    inside = W.partitionBy(*keys, b).orderBy(pos)
    across = W.partitionBy(*keys).orderBy(b) if keys else W.orderBy(b)
    edges = dealt.groupBy(*keys, b).agg(F.min(pos).alias("__first"), F.max(pos).alias("__last")).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(b).alias("__k_bucket"),
        F.lag("__last").over(across).alias("__from_left"),
        F.lead("__first").over(across).alias("__from_right"),
    )
    local = dealt.select(
        "*", F.lag(pos).over(inside).alias("__prev"), F.lead(pos).over(inside).alias("__next")
    )
    on = reduce(
        lambda x, y: x & y,
        [local[k].eqNullSafe(edges[f"__k_{k}"]) for k in keys] + [local[b] == edges["__k_bucket"]],
    )
    return local.join(edges, on, "left").select(
        *points.columns,
        F.coalesce("__prev", "__from_left").alias("prev_pos"),
        F.coalesce("__next", "__from_right").alias("next_pos"),
    )


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    bucket: Column | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles of doubles without collecting a group.

    A (key, value) -> count table gets running counts; the two order statistics around each
    quantile are the first values whose running count passes their rank.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("__n"))
    run = running(
        hist, keys, value, bucket if bucket is not None else signed_bucket(value), {"__cum": ("sum", "__n")}
    )
    total = hist.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    joined = run.join(total, keys) if keys else run.join(F.broadcast(total))
    last = F.col("__total") - 1

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("__cum") > rank, F.col(value)))

    sides = joined.groupBy(*keys, "__total").agg(
        *[at(F.floor(last * q)).alias(f"__lo_{name}") for name, q in quantiles.items()],
        *[at(F.ceil(last * q)).alias(f"__hi_{name}") for name, q in quantiles.items()],
    )
    cut = F.col("__total") - 1
    return sides.select(
        *keys,
        *[
            (
                F.col(f"__lo_{name}")
                + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (cut * q - F.floor(cut * q))
            ).alias(name)
            for name, q in quantiles.items()
        ],
    )


def dense_index(df: DataFrame, key: str, keys: list[str] = (), out: str = "idx") -> DataFrame:
    """Dense 0-based index of distinct keys (per ``keys``), in the order of their MD5 digest."""
    keys = list(keys)
    distinct = df.select(*keys, key).distinct()
    digest = F.md5(F.col(key).cast("string"))
    rows = distinct.withColumn("__o", F.concat(digest, F.col(key).cast("string"))).withColumn(
        "__one", F.lit(1)
    )
    bucket = F.conv(F.substring("__o", 1, 3), 16, 10).cast("bigint")
    run = running(rows, keys, "__o", bucket, {"__r": ("sum", "__one")})
    return run.select(*keys, key, (F.col("__r") - 1).cast("bigint").alias(out))
