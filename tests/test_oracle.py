"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck
from kindred.registry import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
#: Queries that find nothing in the smallest tables (none is empty at the next scale).
EMPTY_HERE = {"agg52_site_base_counts", "agg52_gapped_base_counts", "flt10_allele_balance"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    problem = compare(con, QUERIES[name](spark, SF), ORACLES[name])
    assert problem == "" or problem == "EMPTY" and name in EMPTY_HERE, problem


def test_reference_queries_have_oracles():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_counts_of_the_minimum_slice(spark):
    """Known counts of the first end-to-end question at the middle scale factor."""
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["flagship_trio_rates"](spark, sf).collect()
    assert len(rows) == 20
    assert sum(r.callable_sites for r in rows) == 310
    assert sum(r.n_dnm for r in rows) == 58
    assert QUERIES["flt08_de_novo_candidates"](spark, sf).count() == 95
