"""Genotype matrices: one text line per site becomes one row per site and sample."""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calls import info_map
from ..plans.cut import cut_lineage
from ..plans.lookup import lookup_join
from .tables import lines


def header_samples(rows: DataFrame) -> DataFrame:
    """(path, samples) from the column header line of each file."""
    return rows.filter(F.col("value").startswith("#CHROM")).select(
        same_path("path"), F.slice(F.split("value", "\t"), 10, 1 << 30).alias("samples")
    )


def file_headers(spark: SparkSession, path) -> DataFrame:
    """(path, samples) of each file, reading only the lines above the first site.

    Files are listed without their content and their heads are read in tasks, so finding
    the sample names does not cost a pass over the data.
    """

    def heads(batches):
        import gzip

        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            found = []
            for name in batch["path"]:
                filesystem, inner = fs.FileSystem.from_uri(name)
                # the raw bytes are opened, so compression is handled in one place
                with filesystem.open_input_stream(inner, compression=None) as raw:
                    text = gzip.open(raw, "rt") if name.endswith((".gz", ".bgz")) else io.TextIOWrapper(raw)
                    for line in text:
                        if line.startswith("#CHROM"):
                            found.append((name, line.rstrip("\r\n").split("\t")[9:]))
                            break
                        if not line.startswith("#"):
                            break
            yield pd.DataFrame(found, columns=["path", "samples"])

    listed = spark.read.format("binaryFile").load(path).select(same_path("path"))
    return listed.mapInPandas(heads, "path string, samples array<string>")


def same_path(path: str) -> Column:
    """One spelling of a file URI: ``scheme:/x`` becomes ``scheme:///x``."""
    return F.regexp_replace(path, "^([a-z0-9+.-]+):/(?!/)", "$1:///").alias("path")


_KEYS = ("GT", "DP", "GQ", "RGQ", "AD")


def _located(rows: DataFrame, headers: DataFrame | None) -> DataFrame:
    """Site columns of each line, the place of every FORMAT key, and the names and texts of the samples."""
    body = rows.filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    sites = body.select(same_path("path"), F.split("value", "\t").alias("f"))
    # headers found among the lines are stored: measuring and joining them would read all lines again
    names = headers if headers is not None else cut_lineage(header_samples(rows))
    sites = lookup_join(sites, names, ["path"])
    keys = F.split(F.get("f", F.lit(8)), ":")
    place = {k: F.array_position(keys, k).cast("int").alias(f"i_{k}") for k in _KEYS}
    known = lambda c: F.when(c != ".", c)
    return sites.select(
        F.get("f", F.lit(0)).alias("chrom"),
        F.get("f", F.lit(1)).cast("bigint").alias("pos"),
        known(F.get("f", F.lit(2))).alias("id"),
        F.get("f", F.lit(3)).alias("ref"),
        F.split(F.get("f", F.lit(4)), ",").alias("alt"),
        known(F.get("f", F.lit(5))).try_cast("double").alias("qual"),
        known(F.get("f", F.lit(6))).alias("filter"),
        info_map(F.get("f", F.lit(7))).alias("info"),
        (F.array_position(keys, "GQ") > 0).alias("has_gq"),
        *place.values(),
        F.col("samples"),
        F.slice("f", 10, 1 << 30).alias("texts"),
    )


def _fields(parts: Column) -> list[Column]:
    """The fields of one sample's text, split at colons; '.' is NULL."""

    def value(k: str) -> Column:
        v = F.get(parts, F.col(f"i_{k}") - 1)
        return F.when((F.col(f"i_{k}") > 0) & (v != "."), v)

    return [
        F.when(~value("GT").contains("."), F.replace(value("GT"), F.lit("|"), F.lit("/"))).alias("gt"),
        value("DP").try_cast("int").alias("dp"),
        value("GQ").try_cast("int").alias("gq"),
        value("RGQ").try_cast("int").alias("rgq"),
        F.transform(F.split(value("AD"), ","), lambda x: x.try_cast("int")).alias("ad"),
    ]


SITE_COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "has_gq")


def parse_sites(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One row per line (path, value): the site, its ``samples``, and their ``calls`` in that order.

    This is the form of ``operators.sites``: nothing is exploded, and nothing has to be grouped
    again to see a trio.  Sample names come from the header line of the same file.
    """
    located = _located(rows, headers)
    call = lambda text: F.get(F.transform(F.array(F.split(text, ":")), lambda v: F.struct(*_fields(v))), F.lit(0))
    return located.select(*SITE_COLUMNS, "samples", F.transform("texts", call).alias("calls"))


def parse_calls(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Long call table from lines (path, value).

    Sample names come from the header line of the same file by a join on the path, so files
    with different samples can be read together.  FORMAT keys are located once per site,
    before the samples are exploded.  '.' is NULL.
    """
    located = _located(rows, headers)
    # the site columns are computed below the explode, and the line itself is not carried
    # through it: the work per line grows with its samples, not with their square
    kept = [c for c in located.columns if c not in ("samples", "texts")]
    # texts are split below the explode: above it, a filter on a field would split them again
    fields = F.transform("texts", lambda x: F.split(x, ":"))
    zipped = F.arrays_zip(F.col("samples").alias("name"), fields.alias("v"))
    split = located.select(*kept, F.explode(zipped).alias("s"))
    return split.select(*SITE_COLUMNS, F.col("s.name").alias("sample"), *_fields(F.col("s.v")))


def read_sites(spark: SparkSession, path) -> DataFrame:
    """Genotype matrices as one row per site; ``sample_order`` gives the panel's samples."""
    return parse_sites(lines(spark, path, with_path=True), file_headers(spark, path))


def sample_order(spark: SparkSession, path) -> list[str]:
    """The samples of the files' headers, which have to be the same in all of them."""
    orders = file_headers(spark, path).select("samples").distinct().limit(2).collect()
    if len(orders) != 1:
        raise ValueError("files with different samples: read them as the long table")
    return list(orders[0][0])


def read_calls(spark: SparkSession, path) -> DataFrame:
    """Read genotype matrices.  Write them once with ``write_partitioned(calls, path)``:
    later jobs then prune by chromosome and read only the columns they use."""
    return parse_calls(lines(spark, path, with_path=True), file_headers(spark, path))
