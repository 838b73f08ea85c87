"""Writers: tables partitioned by a column, and tables with their run metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import shared_base


def shared_folder(spark: SparkSession) -> str:
    """New folder name inside the cluster's shared folder (``spark.checkpoint.dir``)."""
    return f"{shared_base(spark).rstrip('/')}/{uuid.uuid4().hex}"


def write_partitioned(
    df: DataFrame, path: str, column: str = "chrom", fmt: str = "parquet", files_per_value: int = 16
) -> None:
    """One directory per value of ``column``.

    Rows are spread over (value, hash slot), so a value with a third of all rows is written
    by ``files_per_value`` tasks instead of one.
    """
    slot = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(files_per_value))
    spread = df.withColumn("__slot", slot).repartition(column, "__slot").drop("__slot")
    spread.write.mode("errorifexists").partitionBy(column).format(fmt).save(path)


def with_metrics(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table and a one-row table of its run metrics."""
    return df, df.agg(*[c.alias(k) for k, c in metrics.items()])


def write_table(
    df: DataFrame, path: str, metrics: DataFrame | dict[str, Column] | None = None, tsv: bool = True
) -> dict | None:
    """Write a table (header TSV or Parquet) and its run metrics next to it.

    Metrics given as aggregate columns are observed while the table is written, in the same pass
    over the data, and returned; distinct counts cannot be observed and go in as a DataFrame.
    """
    spark = df.sparkSession

    def write(part: DataFrame, folder: str) -> None:
        writer = part.write.mode("errorifexists")
        if tsv:
            writer.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(folder)
        else:
            writer.parquet(folder)

    if isinstance(metrics, dict):
        seen = Observation()
        write(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), f"{path}/table")
        found = seen.get
        # One row; empty tables still have their counts.
        write(spark.createDataFrame([tuple(found[k] for k in metrics)], _kinds(df, metrics)), f"{path}/metrics")
        return found
    write(df, f"{path}/table")
    if metrics is not None:
        write(metrics, f"{path}/metrics")
    return None


def _kinds(df: DataFrame, metrics: dict[str, Column]):
    return df.agg(*[c.alias(k) for k, c in metrics.items()]).schema
