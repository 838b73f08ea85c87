"""Line-oriented tables: index, intervals, annotation, depth, mutation and pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.calls import keyed_text


def lines(spark: SparkSession, path, with_path: bool = False) -> DataFrame:
    """Text lines of one or more paths; ``with_path`` adds the file each line came from."""
    text = spark.read.text(path)
    return text.select("value", F.col("_metadata.file_path").alias("path")) if with_path else text


def _field(i: int, kind: str | None = None) -> Column:
    f = F.get(F.col("__f"), F.lit(i))
    return f.try_cast(kind) if kind else f


def _fields(rows: DataFrame, sep: str = "\t") -> DataFrame:
    return rows.filter(F.length(F.trim("value")) > 0).withColumn("__f", F.split("value", sep))


# --- sequence index and intervals ---------------------------------------------------------


def parse_fai(rows: DataFrame) -> DataFrame:
    return _fields(rows).select(
        _field(0).alias("chrom"),
        _field(1, "bigint").alias("length"),
        _field(2, "bigint").alias("offset"),
        _field(3, "int").alias("linebases"),
        _field(4, "int").alias("linewidth"),
    )


def read_fai(spark: SparkSession, path) -> DataFrame:
    return parse_fai(lines(spark, path))


def parse_bed(rows: DataFrame) -> DataFrame:
    """Half-open intervals; empty ones, comments and header lines are dropped."""
    return (
        _fields(rows.filter(~F.col("value").rlike("^(#|track|browser)")))
        .select(_field(0).alias("chrom"), _field(1, "bigint").alias("start"), _field(2, "bigint").alias("end"))
        .filter("end > start")
    )


def read_bed(spark: SparkSession, path) -> DataFrame:
    return parse_bed(lines(spark, path))


def parse_bedgraph(rows: DataFrame) -> DataFrame:
    """Run-length rows with an integer depth (read as a float first)."""
    return (
        _fields(rows.filter(~F.col("value").rlike("^(#|track|browser)")))
        .select(
            _field(0).alias("chrom"),
            _field(1, "bigint").alias("start"),
            _field(2, "bigint").alias("end"),
            _field(3, "double").cast("int").alias("depth"),
        )
        .filter("end > start")
    )


def read_bedgraph(spark: SparkSession, path) -> DataFrame:
    return parse_bedgraph(lines(spark, path))


# --- annotation ----------------------------------------------------------------------------


def attributes(text: Column) -> Column:
    """``k=v;k=v`` as a map; entries without '=' are dropped, the last of repeated keys wins."""
    tidy = F.regexp_replace(F.regexp_replace(text, r"\s*(^|[;=]|$)\s*", "$1"), r"^;+|;+$|(?<=;);+", "")
    pairs = F.filter(F.split(tidy, ";"), lambda e: e.contains("="))
    keys = F.array_distinct(F.transform(pairs, lambda e: F.substring_index(e, "=", 1)))
    value = lambda k: F.element_at(
        F.filter(pairs, lambda e: F.substring_index(e, "=", 1) == k), -1
    )
    slow = F.map_from_arrays(keys, F.transform(keys, lambda k: F.regexp_replace(value(k), "^[^=]*=", "")))
    flagless = tidy.rlike("^[^;=]+=[^;]*(;[^;=]+=[^;]*)*$")
    return F.when(flagless, keyed_text(tidy, slow)).otherwise(slow)


def parse_gff(rows: DataFrame) -> DataFrame:
    """Features with their attribute map; 1-based closed coordinates."""
    return (
        _fields(rows.filter(~F.col("value").startswith("#")))
        .filter(F.size("__f") >= 9)
        .select(
            _field(0).alias("chrom"),
            _field(2).alias("type"),
            _field(3, "bigint").alias("start"),
            _field(4, "bigint").alias("end"),
            _field(6).alias("strand"),
            attributes(_field(8)).alias("attrs"),
        )
    )


def read_gff(spark: SparkSession, path) -> DataFrame:
    return parse_gff(lines(spark, path))


def coding_parts(features: DataFrame) -> DataFrame:
    """(gene, mrna, chrom, strand, start, stop, file_order) from the gene > mRNA > CDS tree.

    A CDS with several parents belongs to each.  File order is approximated by the position
    of the transcript, because rows of a distributed file have no order.
    """
    get = lambda k: F.try_element_at(F.col("attrs"), F.lit(k))
    mrna = features.filter("type = 'mRNA'").select(
        get("ID").alias("mrna"), get("Parent").alias("gene"), F.col("start").alias("__ms")
    )
    cds = features.filter("type = 'CDS'").select(
        "chrom", "strand", "start", F.col("end").alias("stop"), F.explode(F.split(get("Parent"), ",")).alias("mrna")
    )
    return cds.join(mrna, "mrna").select(
        "gene", "mrna", "chrom", "strand", "start", "stop", F.struct("__ms", "mrna").alias("file_order")
    )


# --- depth, mutations, callable tables ---------------------------------------------------------


def parse_depth(rows: DataFrame, chrom: str | None = None, covered_only: bool = True) -> DataFrame:
    out = _fields(rows).select(
        _field(0).alias("chrom"), _field(1, "bigint").alias("pos"), _field(2, "int").alias("depth")
    )
    if chrom is not None:
        out = out.filter(F.col("chrom") == chrom)
    return out.filter("depth > 0") if covered_only else out


def read_depth(spark: SparkSession, path, chrom: str | None = None, covered_only: bool = True) -> DataFrame:
    return parse_depth(lines(spark, path), chrom, covered_only)


def require_columns(df: DataFrame, required: list[str], name: str = "table") -> DataFrame:
    """The table itself, or an error that names the first column it lacks and those it has."""
    for column in required:
        if column not in df.columns:
            raise ValueError(f"no column {column!r} in {name}; it has {df.columns}")
    return df


# Columns every mutation table has.
DNM_COLUMNS = ["chrom", "pos", "ref", "alt", "child", "father", "mother"]


def read_dnm(spark: SparkSession, path, required: list[str] = DNM_COLUMNS) -> DataFrame:
    """Header TSV; ``pos`` becomes an integer, the other columns stay text."""
    df = spark.read.csv(path, sep="\t", header=True)
    require_columns(df, required, str(path))
    return df.withColumn("pos", F.col("pos").cast("bigint"))


def parse_callable_summary(rows: DataFrame, strict: bool = False) -> DataFrame:
    """chrom, bp and the individual (tag without ``_{chrom}``).

    Malformed rows are dropped, or fail on execution with ``strict``.
    """
    parsed = _fields(rows).select(
        _field(0).alias("chrom"),
        _field(1, "bigint").alias("bp"),
        ids.strip_suffix(_field(2), F.concat(F.lit("_"), _field(0))).alias("individual"),
        "value",
    )
    bad = F.col("individual").isNull() | F.col("bp").isNull()
    if strict:
        parsed = parsed.withColumn(
            "individual",
            F.when(bad, F.raise_error(F.concat(F.lit("malformed row: "), F.col("value")))).otherwise(
                F.col("individual")
            ),
        )
        return parsed.drop("value")
    return parsed.filter(~bad).drop("value")


def read_callable_summary(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    return parse_callable_summary(lines(spark, path), strict)


def parse_pairs(rows: DataFrame, header: list[str], wanted: dict[str, tuple[str, str]], sep: str = r"\s+") -> DataFrame:
    """Columns of a headed table by name: ``wanted`` maps output -> (source column, type).

    A source column that the header does not have gives NULL; values that do not parse are
    NULL.  The header line itself is dropped.
    """
    at = {name: i for i, name in enumerate(header)}
    body = rows.withColumn("__t", F.trim("value")).filter((F.length("__t") > 0))
    body = body.withColumn("__f", F.split("__t", sep)).filter(
        ~(F.get("__f", F.lit(0)) == header[0]) | ~(F.size("__f") == len(header)) | ~(F.get("__f", F.lit(len(header) - 1)) == header[-1])
    )
    return body.select(
        *[
            (_field(at[src], None if kind == "string" else kind) if src in at else F.lit(None).cast(kind)).alias(out)
            for out, (src, kind) in wanted.items()
        ]
    )


def read_pairs(spark: SparkSession, path, wanted: dict[str, tuple[str, str]], sep: str = r"\s+") -> DataFrame:
    """Read a whitespace or tab separated pair table; the header is its first line."""
    import re

    rows = lines(spark, path)
    first = rows.filter(F.length(F.trim("value")) > 0).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    return parse_pairs(rows, re.split(sep, first.value.strip()), wanted, sep)


# --- many files -----------------------------------------------------------------------------------


def with_provenance(rows: DataFrame, pattern: str, names: list[str], path: str = "path") -> DataFrame:
    """Columns from the capture groups of a pattern on the file name."""
    base = F.substring_index(F.col(path), "/", -1)
    return rows.select(
        "*", *[F.nullif(F.regexp_extract(base, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)]
    )


def union_files(spark: SparkSession, glob: str, pattern: str, names: list[str]) -> DataFrame:
    """Lines of all files of a glob with their provenance; an empty set raises when read."""
    return with_provenance(lines(spark, glob, with_path=True), pattern, names)
