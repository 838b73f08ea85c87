"""Fields of call rows, allele choice and small odds arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def keyed_text(text: Column, slow: Column) -> Column:
    """``k=v;k=v`` as a map by the built-in splitter; text with repeated keys, which the
    splitter rejects, goes through ``slow``."""
    keys = F.split(F.regexp_replace(text, "=[^;]*", ""), ";")
    plain = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(plain, F.str_to_map(text, F.lit(";"), F.lit("="))).otherwise(slow)


def info_map(info: str | Column) -> Column:
    """``k=v;flag`` text as a map; a flag without a value maps to 'true'."""
    text = F.regexp_replace(_c(info), r"^[;.]+$|^;+|;+$|(?<=;);+", "")
    entries = F.filter(F.split(text, ";"), lambda e: F.length(e) > 0)
    # the last of repeated keys wins, as in a plain dictionary
    keys = F.array_distinct(F.transform(entries, lambda e: F.substring_index(e, "=", 1)))

    def value(key: Column) -> Column:
        last = F.element_at(
            F.filter(entries, lambda e: F.substring_index(e, "=", 1) == key), -1
        )
        return F.when(last.contains("="), F.regexp_replace(last, "^[^=]*=", ""))

    slow = F.map_from_arrays(keys, F.transform(keys, value))
    return F.when(
        F.length(text) > 0,
        F.transform_values(keyed_text(text, slow), lambda k, v: F.coalesce(v, F.lit("true"))),
    ).otherwise(F.create_map().cast("map<string,string>"))


def info_get(info: str | Column, key: str) -> Column:
    return F.try_element_at(_c(info), F.lit(key))


def format_get(format_keys: str | Column, values: str | Column, key: str) -> Column:
    """Value of a FORMAT key in a sample field; NULL when the key or the value is missing."""
    at = F.array_position(F.split(_c(format_keys), ":"), key).cast("int")
    value = F.get(F.split(_c(values), ":"), at - 1)
    return F.when((at > 0) & (value != "."), value)


def normalize_gt(gt: str | Column) -> Column:
    return F.replace(_c(gt), F.lit("|"), F.lit("/"))


def genotype_class(gt: str | Column) -> Column:
    """hom_ref, het, hom_alt, or NULL for missing and multi-allelic genotypes."""
    g = normalize_gt(gt)
    return (
        F.when(g == "0/0", "hom_ref")
        .when(g.isin("0/1", "1/0"), "het")
        .when(g == "1/1", "hom_alt")
    )


def dp4_support(dp4: str | Column) -> tuple[Column, Column]:
    """(reference, alternate) read support from four strand counts; NULL when malformed."""
    n = F.transform(F.split(_c(dp4), ","), lambda x: x.try_cast("int"))
    ok = (F.size(n) >= 4) & F.forall(F.slice(n, 1, 4), lambda x: x.isNotNull())
    return F.when(ok, n[0] + n[1]), F.when(ok, n[2] + n[3])


def site_quality(gq: str | Column, rgq: str | Column, has_gq: str | Column | None = None) -> Column:
    """GQ when the field is there, otherwise RGQ, otherwise 0.

    ``has_gq`` says whether the site has a GQ field at all: where it has one, a missing value
    is 0 and does not fall through to RGQ.  Without it a missing GQ counts as no field.
    """
    if has_gq is None:
        return F.coalesce(_c(gq), _c(rgq), F.lit(0))
    return F.coalesce(F.when(_c(has_gq), _c(gq)).otherwise(_c(rgq)), F.lit(0))


def variant_id(vid: str | Column, chrom: str | Column, pos: str | Column) -> Column:
    """Missing ids become ``chrom:pos``."""
    v = _c(vid)
    return F.when(
        v.isNull() | (v == "."), F.concat_ws(":", _c(chrom), _c(pos).cast("string"))
    ).otherwise(v)


def seeded_choice(seed, species: str | Column, chrom: str | Column, pos: str | Column) -> Column:
    """True when the first byte of SHA-256('seed:species:chrom:pos') is odd."""
    token = F.concat_ws(":", F.lit(str(seed)), _c(species), _c(chrom), _c(pos).cast("string"))
    return F.conv(F.substring(F.sha2(token, 256), 1, 2), 16, 10).cast("int") % 2 == 1


def resolve_allele(
    classification, mode, relaxed, choice, ref_support, alt_support
) -> Column:
    """alt, ref or uncallable.

    ``mode`` (column): using_alt, using_ref, random, majority.  ``relaxed`` (column): unclean
    heterozygotes may be used.  Missing read support under majority is uncallable.
    """
    label, how = _c(classification), _c(mode)
    usable = (label == "het_clean") | ((label == "het_unclean") & _c(relaxed))
    r, a = _c(ref_support), _c(alt_support)
    return (
        F.when(label == "hom_alt", "alt")
        .when(label == "hom_ref", "ref")
        .when(~usable, "uncallable")
        .when(how == "using_alt", "alt")
        .when(how == "using_ref", "ref")
        .when(how == "random", F.when(_c(choice), "alt").otherwise("ref"))
        .when((how == "majority") & (r.isNull() | a.isNull()), "uncallable")
        .when(how == "majority", F.when(a > r, "alt").otherwise("ref"))
    )


def log2_odds(a, b, c, d, eps: float = 0.5) -> Column:
    a, b, c, d = (_c(x) + F.lit(eps) for x in (a, b, c, d))
    return F.log2((a * d) / (b * c))


def pseudocount_odds(a, b, c, d, eps: float = 1.0) -> Column:
    a, b, c, d = (_c(x) + F.lit(eps) for x in (a, b, c, d))
    return (a * d) / (b * c)


def raw_odds(a, b, c, d) -> Column:
    """a·d / (b·c); NULL when the denominator is 0."""
    a, b, c, d = (_c(x).cast("double") for x in (a, b, c, d))
    return F.try_divide(a * d, F.when(b * c != 0, b * c))


def significance_stars(p: str | Column) -> Column:
    """Stars at .001, .01 and .05, 'ns' above, empty for a missing p-value."""
    p = _c(p)
    return (
        F.when(p.isNull() | F.isnan(p), "")
        .when(p < 0.001, "***")
        .when(p < 0.01, "**")
        .when(p < 0.05, "*")
        .otherwise("ns")
    )


def degree_of_kinship(kinship, ibs0, t=(0.354, 0.177, 0.0884, 0.0442), ibs0_po_max=0.005) -> Column:
    """Relationship band of a kinship coefficient; first degree is split by IBS0."""
    k, z = _c(kinship), _c(ibs0)
    present = k.isNotNull() & ~F.isnan(k)
    parent_like = z.isNotNull() & ~F.isnan(z) & (z <= ibs0_po_max)
    return (
        F.when(~present, "NA")
        .when(k > t[0], "duplicate/MZ")
        .when(k > t[1], F.when(parent_like, "parent-offspring").otherwise("full-sibling"))
        .when(k > t[2], "2nd-degree")
        .when(k > t[3], "3rd-degree")
        .otherwise("unrelated")
    )
