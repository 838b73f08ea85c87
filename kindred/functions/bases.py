"""Alleles, sequence contexts and mutation classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes and their complements.
IUPAC = "ACGTRYSWKMBDHVN"
IUPAC_COMPLEMENT = "TGCAYRSWMKVHDBN"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq: str | Column) -> Column:
    return F.translate(
        _c(seq), IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower()
    )


def revcomp(seq: str | Column) -> Column:
    return F.reverse(complement(seq))


def is_base(x: str | Column) -> Column:
    return _c(x).rlike("^[ACGT]$")


def is_pyrimidine(x: str | Column) -> Column:
    return _c(x).isin("C", "T")


def fold_trinuc(context: str | Column) -> Column:
    """Pyrimidine-centred form of a three-base context; NULL unless all bases are ACGT."""
    ctx = F.upper(_c(context))
    return F.when(
        ctx.rlike("^[ACGT]{3}$"),
        F.when(is_pyrimidine(F.substring(ctx, 2, 1)), ctx).otherwise(revcomp(ctx)),
    )


def folded_site(ref, alt, before, after) -> Column:
    """Four letters on the pyrimidine strand: 5' base, REF, 3' base, ALT.

    NULL unless all are plain bases and REF and ALT differ.  The labels below are each one
    rewrite of this string, so the folding is evaluated once per label.
    """
    five, r, three, a = (F.upper(_c(x)) for x in (before, ref, after, alt))
    return F.when(
        F.concat(five, r, three, a).rlike("^[ACGT]([ACGT])[ACGT](?!\\1)[ACGT]$"),
        F.when(is_pyrimidine(r), F.concat(five, r, three, a)).otherwise(
            F.translate(F.concat(three, r, five, a), "ACGT", "TGCA")
        ),
    )


def category_of_site(site: Column) -> Column:
    """``A[C>T]G`` from the four letters of ``folded_site``."""
    return F.regexp_replace(site, "^(.)(.)(.)(.)$", r"$1[$2>$4]$3")


def class7_of_site(site: Column) -> Column:
    """Substitution class with C>T split by a 3' G."""
    split = F.regexp_replace(site, "^.CGT$", "C>T_CpG")
    split = F.regexp_replace(split, "^.C.T$", "C>T_nonCpG")
    return F.regexp_replace(split, "^.(.).(.)$", r"$1>$2")


def sbs96(ref, alt, before, after) -> Column:
    """``A[C>T]G`` category, or NULL when an allele or a flank is not a plain base."""
    return category_of_site(folded_site(ref, alt, before, after))


def sbs_class7(ref, alt, context) -> Column:
    """Substitution class with C>T split by a 3' G; NULL when centre and REF disagree."""
    ctx = F.upper(_c(context))
    left, centre, right = (F.substring(ctx, i, 1) for i in (1, 2, 3))
    site = folded_site(ref, alt, left, right)
    return F.when((F.length(ctx) == 3) & (centre == F.upper(_c(ref))), class7_of_site(site))


def class7_of_category(category: str | Column) -> Column:
    """Class of a 96-category label such as ``A[C>T]G``."""
    cat = _c(category)
    sub = F.substring(cat, 3, 3)
    return F.when(
        sub == "C>T", F.when(F.substring(cat, 7, 1) == "G", "C>T_CpG").otherwise("C>T_nonCpG")
    ).otherwise(sub)


def mutation_labels(before, ref, after, alt) -> tuple[Column, Column, Column]:
    """(mut_type, if_CpG, if_CPD): a C>T with a G on either side is CpG, with a pyrimidine
    on either side is dipyrimidine, and the type lists every label that applies."""
    r = F.upper(_c(ref))
    raw = F.concat(F.upper(_c(before)), r, F.upper(_c(after)))
    ctx = F.when(is_pyrimidine(r), raw).otherwise(revcomp(raw))
    a = F.when(is_pyrimidine(r), F.upper(_c(alt))).otherwise(complement(F.upper(_c(alt))))
    left, centre, right = (F.substring(ctx, i, 1) for i in (1, 2, 3))
    c_to_t = (centre == "C") & (a == "T")
    cpg = c_to_t & ((left == "G") | (right == "G"))
    cpd = c_to_t & (left.isin("C", "T") | right.isin("C", "T"))
    plain = F.concat(centre, F.lit(">"), a)
    known = plain.isin("C>A", "C>G", "T>A", "T>C", "T>G")
    mut_type = (
        F.when(
            c_to_t,
            F.concat_ws(
                ",", F.lit("C>T"), F.when(cpg, "CpG>TpG"), F.when(cpd, "C>T_CPD")
            ),
        )
        .when(known, plain)
        .otherwise("Other")
    )
    return mut_type, F.coalesce(cpg, F.lit(False)), F.coalesce(cpd, F.lit(False))


def is_cg_site(context: str | Column) -> Column:
    """C next to a G, or G next to a C, on either side."""
    left, centre, right = (F.substring(_c(context), i, 1) for i in (1, 2, 3))
    return ((centre == "C") & ((left == "G") | (right == "G"))) | (
        (centre == "G") & ((left == "C") | (right == "C"))
    )


def is_cpd_site(context: str | Column) -> Column:
    """C next to a pyrimidine, or G next to a purine, on either side."""
    left, centre, right = (F.substring(_c(context), i, 1) for i in (1, 2, 3))
    return ((centre == "C") & (left.isin("C", "T") | right.isin("C", "T"))) | (
        (centre == "G") & (left.isin("A", "G") | right.isin("A", "G"))
    )


def clean_sequence(seq: str | Column) -> Column:
    """Upper case, everything but ACGT becomes N."""
    return F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "N")


def n_fraction(seq: str | Column) -> Column:
    s = _c(seq)
    size = F.length(s)
    return F.when(size == 0, F.lit(1.0)).otherwise(
        (size - F.length(F.replace(s, F.lit("N"), F.lit("")))) / size
    )


def codons(seq: str | Column) -> Column:
    """Array of the complete codons of a sequence."""
    return F.regexp_extract_all(_c(seq), F.lit("(...)"), F.lit(1))


def has_premature_stop(seq: str | Column) -> Column:
    """A stop codon before the last one (TAA, TAG, TGA)."""
    s = _c(seq)
    inner = F.slice(codons(s), 1, F.greatest(F.size(codons(s)) - 1, F.lit(0)))
    return F.when(F.length(s) < 6, F.lit(False)).otherwise(
        F.arrays_overlap(inner, F.array(F.lit("TAA"), F.lit("TAG"), F.lit("TGA")))
    )


def cg_sites(seq: str | Column) -> Column:
    """Bases with both neighbours in ``seq`` that are the C or the G of a CG or GC pair."""
    inner = "(?<=.)C(?=G)|(?<=G)C(?=.)|(?<=C)G(?=.)|(?<=.)G(?=C)"
    return F.regexp_count(F.upper(_c(seq)), F.lit(inner)).cast("bigint")


def cpd_sites(seq: str | Column) -> Column:
    """Bases with both neighbours in ``seq`` that are in a dipyrimidine on either strand."""
    inner = "(?<=[CT])C(?=.)|(?<=.)C(?=[CT])|(?<=[AG])G(?=.)|(?<=.)G(?=[AG])"
    return F.regexp_count(F.upper(_c(seq)), F.lit(inner)).cast("bigint")
