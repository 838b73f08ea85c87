"""Dimension tables from a configuration dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def species_dims(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Tables ``species``, ``x_chromosomes``, ``excluded_trios``, ``groups``, ``sister_pairs``.

    ``config``: {"species": {name: {"sociality", "x_chromosomes", "exclude_trios"}},
    "groups": {group: [species]}, "sister_pairs": [[first, second]]}.  Species keep their
    order as ``leaf_order``.  Groups may overlap.
    """
    species = config.get("species", {})
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    unknown = {
        m for members in config.get("groups", {}).values() for m in members if m not in species
    } | {m for pair in config.get("sister_pairs", []) for m in pair if m not in species}
    if unknown:
        raise ValueError(f"unknown species: {', '.join(sorted(unknown))}")
    return {
        "species": table(
            [(s, c.get("sociality"), i) for i, (s, c) in enumerate(species.items())],
            "species string, sociality string, leaf_order int",
        ),
        "x_chromosomes": table(
            [(s, x) for s, c in species.items() for x in c.get("x_chromosomes", [])],
            "species string, chrom string",
        ),
        "excluded_trios": table(
            [(s, x) for s, c in species.items() for x in c.get("exclude_trios", [])],
            "species string, child string",
        ),
        "groups": table(
            [(g, s) for g, members in config.get("groups", {}).items() for s in members],
            "group_name string, species string",
        ),
        "sister_pairs": table(
            [tuple(p) for p in config.get("sister_pairs", [])], "first string, second string"
        ),
    }
