"""Trio filters site by site: one row per site with an array of calls, one entry per sample.

A genotype matrix has all samples of a site in one line, so everything about a trio at a site is
already in one row.  A ``Panel`` fixes the order of the samples and holds the trios as places in
that order; a trio is judged by looking up three entries of the array.  Mean depths per sample and
chromosome are one array per chromosome, joined as a size-checked lookup.  Nothing of the call
side is shuffled between the scan and the candidates.

Columns: the site's own, and ``calls``, an array with an entry of call fields (at least ``gt`` and
``dp``) or NULL for each sample of the panel.  The results have the columns of the long form in
``operators.trios``: f_* father, m_* mother, c_* child.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls as fc
from ..plans.cut import cut_lineage
from ..plans.lookup import lookup_join
from . import trios as tr

#: The trios are part of the plan, as the samples are part of every row.
MOST_TRIOS = 100_000

_TRIO = "array<struct<family:string,father:string,mother:string,child:string,f:int,m:int,c:int>>"


@dataclass(frozen=True)
class Panel:
    """Order of the samples in ``calls``, and (family, mother, father, child) of each trio."""

    samples: tuple[str, ...]
    trios: tuple[tuple[str, str, str, str], ...] = field(default=())

    def places(self) -> dict[str, int]:
        return {s: i for i, s in enumerate(self.samples)}

    def literal(self) -> Column:
        """The trios as one array column, constant-folded."""
        at = self.places()
        rows = [
            {"family": fam, "father": fa, "mother": mo, "child": ch, "f": at[fa], "m": at[mo], "c": at[ch]}
            for fam, mo, fa, ch in self.trios
            if fa in at and mo in at and ch in at
        ]
        return F.from_json(F.lit(json.dumps(rows)), _TRIO)

    def sample_names(self) -> Column:
        return F.from_json(F.lit(json.dumps(list(self.samples))), "array<string>")


def panel(samples: Iterable[str], pedigree: DataFrame) -> Panel:
    """The panel of a header's samples and a pedigree table (family, mother, father, child)."""
    rows = pedigree.select("family", "mother", "father", "child").limit(MOST_TRIOS + 1).collect()
    if len(rows) > MOST_TRIOS:
        raise ValueError("more trios than a plan can hold; use the long form of operators.trios")
    return Panel(tuple(samples), tuple(sorted(map(tuple, rows))))


def from_long(calls: DataFrame, samples: Panel, fields: list[str], site: list[str] = ("chrom", "pos"), site_fields: list[str] = ()) -> DataFrame:
    """Site rows from the long call table: one grouping on the site, bounded by the samples.

    Of repeated rows of a sample at a site the smallest is taken, NULLs first; samples outside
    the panel are left out.
    """
    place = F.array_position(samples.sample_names(), F.col("sample")).cast("int") - 1
    entry = F.struct(place.alias("place"), F.struct(*fields).alias("call"))
    listed = (
        calls.select(*site, *site_fields, entry.alias("__e"))
        .filter("__e.place >= 0")
        .groupBy(*site, *site_fields)
        .agg(F.sort_array(F.collect_list("__e")).alias("__l"))
    )
    n = len(samples.samples)
    # One entry per sample and in order: the list is the array.  Otherwise entries are looked up.
    every = F.sequence(F.lit(0), F.lit(n - 1))
    complete = F.transform("__l", lambda x: x["place"]) == every
    sparse = F.transform(every, lambda i: F.get(F.filter("__l", lambda x: x["place"] == i), F.lit(0))["call"])
    calls_array = F.when(complete, F.transform("__l", lambda x: x["call"])).otherwise(sparse)
    return listed.select(*site, *site_fields, calls_array.alias("calls"))


def to_long(sites: DataFrame, samples: Panel, site: list[str]) -> DataFrame:
    """One row per site and sample with a call."""
    zipped = F.arrays_zip(samples.sample_names().alias("sample"), F.col("calls").alias("call"))
    return (
        sites.select(*site, F.explode(zipped).alias("__e"))
        .filter("__e.call IS NOT NULL")
        .select(*site, F.col("__e.sample").alias("sample"), "__e.call.*")
    )


# --- depth and callability ------------------------------------------------------------------


def mean_depths(sites: DataFrame, samples: Panel) -> DataFrame:
    """(chrom, means): mean depth of each sample of the panel on a chromosome, NULL without calls.

    Partial sums per task and (chromosome, sample), then one array per chromosome.
    """
    per = (
        sites.select("chrom", F.posexplode("calls").alias("place", "call"))
        .filter("call.dp IS NOT NULL")
        .groupBy("chrom", "place")
        .agg(F.avg("call.dp").alias("mean"))
    )
    pairs = per.groupBy("chrom").agg(F.map_from_entries(F.collect_list(F.struct("place", "mean"))).alias("__m"))
    every = F.sequence(F.lit(0), F.lit(len(samples.samples) - 1))
    return pairs.select("chrom", F.transform(every, lambda i: F.try_element_at("__m", i)).alias("means"))


def with_means(sites: DataFrame, means: DataFrame) -> DataFrame:
    """Add ``means`` to every site.  The stored table is measured, and broadcast within the bounds."""
    return lookup_join(sites, cut_lineage(means.select("chrom", "means")), ["chrom"], "left")


def call_passes(
    call: Column, mean: Column, lo: float = 0.5, hi: float = 2.0, min_q: int = 60, min_dp: int = 0, has_gq: str | None = None
) -> Column:
    """Depth within [lo, hi] times the sample's mean and quality of at least ``min_q``.

    ``has_gq`` names the site column that says whether GQ is among its fields; where it is not,
    RGQ stands in.  An absent call, or no mean, fails.
    """
    dp = F.coalesce(call["dp"], F.lit(0))
    quality = fc.site_quality(call["gq"], call["rgq"], has_gq) if has_gq else F.coalesce(call["gq"], F.lit(0))
    return F.coalesce((dp >= mean * lo) & (dp <= mean * hi) & (quality >= min_q) & (dp >= min_dp), F.lit(False))


def callable_sites(sites: DataFrame, by: list[str], n_samples: int | None = None, **bounds) -> DataFrame:
    """Sites (with ``means``) where every call passes; ``n_samples`` also fails absent calls."""
    judged = F.transform(
        "calls", lambda x, i: F.when(x.isNotNull(), call_passes(x, F.get("means", i), **bounds))
    )
    with_ok = sites.select(*by, F.filter(judged, lambda x: x.isNotNull()).alias("__ok"))
    keep = F.forall("__ok", lambda x: x) & (F.size("__ok") > 0)
    if n_samples is not None:
        keep = keep & (F.size("__ok") == n_samples)
    return with_ok.filter(keep).select(*by, F.size("__ok").cast("bigint").alias("n_calls"))


# --- trios -----------------------------------------------------------------------------------


def trio_rows(
    sites: DataFrame,
    samples: Panel,
    fields: list[str],
    site: list[str] = ("chrom", "pos"),
    site_fields: list[str] = (),
    passes: Callable[[Column, Column], Column] | None = None,
    keep: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """One row per site and trio whose three members have calls (and pass, and are kept).

    ``passes`` judges a call and its sample's mean depth; ``keep`` the calls of father, mother
    and child.  Both are applied where the site is read: rows that fail are never built.
    """
    rows = sites.withColumn("__t", F.explode(samples.literal()))
    call = {w: F.get("calls", F.col(f"__t.{w}")) for w in "fmc"}
    there = [call[w].isNotNull() for w in "fmc"]
    if passes is not None:
        there += [passes(call[w], F.get("means", F.col(f"__t.{w}"))) for w in "fmc"]
    if keep is not None:
        there.append(keep(call["f"], call["m"], call["c"]))
    for condition in there:
        rows = rows.filter(condition)
    return rows.select(
        *site,
        F.col("__t.family").alias("family"),
        *site_fields,
        *[F.col(f"__t.{x}").alias(x) for x in ("father", "mother", "child")],
        *[call[w][x].alias(f"{w}_{x}") for w in "fmc" for x in fields],
    )


def callable_trio_sites(
    sites: DataFrame, samples: Panel, fields: list[str] = (), site_fields: list[str] = (), **bounds
) -> DataFrame:
    """(site, trio) rows where mother, father and child are present and pass."""
    return trio_rows(
        sites, samples, ["dp", *fields], site_fields=site_fields, passes=lambda x, m: call_passes(x, m, **bounds)
    )


def trio_sites(sites: DataFrame, samples: Panel, max_alleles: int = 2, alt: str = "alt") -> DataFrame:
    """Trio sites with at most ``max_alleles`` alleles and no missing genotype."""
    n_alt = F.size(alt) if dict(sites.dtypes)[alt].startswith("array") else F.size(F.split(alt, ","))
    called = lambda x: x["gt"].isNotNull() & ~x["gt"].contains(".")
    return trio_rows(
        sites.filter(n_alt + 1 <= max_alleles), samples, ["gt"], keep=lambda f, m, c: called(f) & called(m) & called(c)
    )


def callable_candidates(
    sites: DataFrame, samples: Panel, fields: list[str] = (), site_fields: list[str] = (),
    ref: str = "ref", alt: str = "alt", **bounds,
) -> DataFrame:
    """De novo candidates: single-base sites where the parents are 0/0, the child 0/1, and all pass."""
    fields = ["dp", "gt", *[x for x in fields if x != "gt"]]
    return trio_rows(
        tr.biallelic_snps(sites, ref, alt), samples, fields, site_fields=site_fields,
        keep=lambda f, m, c: (f["gt"] == "0/0") & (m["gt"] == "0/0") & (c["gt"] == "0/1"),
        passes=lambda x, mean: call_passes(x, mean, **bounds),
    )


def hemizygous_candidates(sites: DataFrame, samples: Panel, sex: DataFrame, min_dp: int, fields: list[str] = (), **bounds) -> DataFrame:
    """X chromosome: parents 0/0, daughters 0/1, sons 1/1, depth floors by ploidy.

    Genotypes and depths are judged at the site; the child's sex is a lookup on what is left.
    """
    some = trio_rows(
        sites, samples, ["dp", "gt", *[x for x in fields if x != "gt"]],
        keep=lambda f, m, c: (f["gt"] == "0/0") & (m["gt"] == "0/0") & c["gt"].isin("0/1", "1/1"),
        passes=lambda x, mean: call_passes(x, mean, **bounds),
    )
    return tr.hemizygous_candidates(tr.ploidy_min_depth(some, sex, min_dp))


def mendel_consistency(
    sites: DataFrame, samples: Panel, pedigree: DataFrame, min_gq: float = 20, min_dp: float = 26,
    consistency_min: float = 0.9, min_sites: int = 100,
) -> DataFrame:
    """Share of heterozygous offspring where the parents are opposite homozygotes.

    Calls below a floor count as missing (a missing GQ or DP does not mask).  Only partial counts
    per trio leave a task.
    """

    def state(x: Column) -> Column:
        low = F.coalesce(x["gq"] < min_gq, F.lit(False)) | F.coalesce(x["dp"] < min_dp, F.lit(False))
        return F.when(~low, fc.genotype_class(x["gt"]))

    opposite = lambda f, m, c: (
        ((state(f) == "hom_ref") & (state(m) == "hom_alt")) | ((state(f) == "hom_alt") & (state(m) == "hom_ref"))
    ) & state(c).isNotNull()
    child = F.struct(*[F.col(f"c_{x}").alias(x) for x in ("gt", "gq", "dp")])
    informative = trio_rows(sites, samples, ["gt", "gq", "dp"], keep=opposite)
    counts = informative.withColumn("c_state", state(child))
    return tr.mendel_report(counts, pedigree, consistency_min, min_sites)
