"""Identifiers: samples, families, roles, chromosomes, read files and gene names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _group(x: Column, pattern: str, group: int) -> Column:
    """Capture group, or NULL when the pattern does not match."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


CHILD_PATTERN = r"^([A-Z0-9]+)_(family\d+)_S\d+_offspring$"


def child_species(child: str | Column) -> Column:
    return _group(F.trim(_c(child)), CHILD_PATTERN, 1)


def child_family_label(child: str | Column) -> Column:
    """``SP_familyN`` of an offspring id, NULL when the id has another shape."""
    c = F.trim(_c(child))
    return F.when(
        c.rlike(CHILD_PATTERN),
        F.concat_ws(
            "_", F.regexp_extract(c, CHILD_PATTERN, 1), F.regexp_extract(c, CHILD_PATTERN, 2)
        ),
    )


def family_key(child: str | Column) -> Column:
    """Everything before the last ``_S``."""
    return F.regexp_replace(_c(child), r"_S(?!.*_S).*$", "")


def sample_family(sample: str | Column) -> Column:
    """Second ``_`` token, or the whole id when there is only one."""
    s = _c(sample)
    return F.coalesce(F.get(F.split(s, "_"), F.lit(1)), s)


def _role_letter(sample: str | Column) -> Column:
    return F.upper(F.substring(F.get(F.split(_c(sample), "_"), F.lit(2)), 1, 1))


def trio_role(sample: str | Column) -> Column:
    """F, M, offspring or unknown from the third token."""
    t = _role_letter(sample)
    return F.when(t == "S", "offspring").when(t.isin("F", "M"), t).otherwise("unknown")


def kin_role(sample: str | Column) -> Column:
    t = _role_letter(sample)
    return F.when(t == "S", "offspring").when(t.isin("F", "M"), "parent").otherwise("unknown")


def batch_role(individual: str | Column) -> Column:
    """proband for ``...S<n>`` or ``..._<n>``, otherwise parent."""
    return F.when(_c(individual).rlike(r"(?:S\d+|_\d+)$"), "proband").otherwise("parent")


def family_role(individual: str | Column) -> Column:
    """offspring, mother or father."""
    i = _c(individual)
    return (
        F.when(i.rlike(r"(?:S\d+|_\d+)$"), "offspring")
        .when(i.rlike(r"(?:Fema|female|Female|F)$"), "mother")
        .otherwise("father")
    )


def sociality(species: str | Column, social: list[str]) -> Column:
    return F.when(_c(species).isin(*social), "Social").otherwise("Subsocial")


def strip_suffix(tag: str | Column, suffix: Column) -> Column:
    """Tag without a trailing suffix; NULL when the suffix is not there."""
    t = _c(tag)
    return F.when(
        F.endswith(t, suffix), F.substring(t, F.lit(1), F.length(t) - F.length(suffix))
    )


def is_autosome(chrom: str | Column) -> Column:
    """Exactly two ``_`` tokens, the second all digits."""
    return _c(chrom).rlike(r"^[^_]*_[0-9]+$")


def is_sex_contig(chrom: str | Column) -> Column:
    """Last token starts with X, Y, Z or W."""
    return _c(chrom).rlike(r"(^|_)[XYZWxyzw][^_]*$")


def chrom_rank(chrom: str | Column) -> Column:
    """Natural order: the number after the first ``_``; X contigs come after by +1000."""
    token = F.get(F.split(_c(chrom), "_"), F.lit(1))
    return F.when(
        token.startswith("X"), F.substring(token, 2, 12).cast("int") + 1000
    ).otherwise(token.cast("int"))


def natural_key(name: str | Column, prefix: str) -> Column:
    """First integer that follows ``prefix`` in a name, for natural sorting."""
    return F.regexp_extract(_c(name), f"{prefix}([0-9]+)", 1).cast("int")


def run_and_lane(filename: str | Column) -> tuple[Column, Column]:
    """(run, lane) of a read file name such as ``PE100_RUN_L01_..._1.fq.gz``, else NA."""
    stem = F.regexp_replace(_c(filename), r"[_.][12]\.fq\.gz$", "")
    stem = F.regexp_replace(stem, r"^PE\d+_", "")
    pattern = r"^([^_]+)_(L\d+)_"
    hit = stem.rlike(pattern)
    return (
        F.when(hit, F.regexp_extract(stem, pattern, 1)).otherwise("NA"),
        F.when(hit, F.regexp_extract(stem, pattern, 2)).otherwise("NA"),
    )


def read_sample_name(path: str | Column, species: str | Column) -> tuple[Column, Column]:
    """(sample name, read pair) from ``.../family/individual/file<1|2>.ext``."""
    parts = F.split(_c(path), "/")
    stem = F.get(F.split(F.element_at(parts, -1), r"\."), F.lit(0))
    token = F.element_at(F.split(F.element_at(parts, -2), r"[_\-.]"), -1)
    tail = (
        F.when(token.isin("F", "female", "Fema"), "F_female")
        .when(token.isin("M", "male", "Ma", "Male"), "M_male")
        .otherwise(
            F.concat(
                F.when(token.contains("S"), token).otherwise(F.concat(F.lit("S"), token)),
                F.lit("_offspring"),
            )
        )
    )
    return (
        F.concat_ws("_", _c(species), F.element_at(parts, -3), tail),
        F.substring(stem, -1, 1),
    )


def protein_gene(query: str | Column) -> Column:
    """Entry name without ``_HUMAN`` from ``db|accession|ENTRY_HUMAN``, else the query id."""
    q = _c(query)
    entry = F.get(F.split(q, r"\|"), F.lit(2))
    return F.when(
        entry.contains("_HUMAN"), F.replace(entry, F.lit("_HUMAN"), F.lit(""))
    ).otherwise(q)


def description_gene(header: str | Column) -> Column:
    """Value of ``GN=`` in a protein header, else NULL."""
    return _group(_c(header), r"\sGN=(\S+)", 1)


def transcript_gene(subject: str | Column) -> Column:
    """Transcript id without a trailing ``.t<digits>``."""
    return F.regexp_replace(_c(subject), r"\.t\d+$", "")


def feature_gene(feature_id: str | Column) -> Column:
    """Part before the first literal ``.t``."""
    return F.substring_index(_c(feature_id), ".t", 1)
