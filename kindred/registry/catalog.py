"""All registered queries; importing this module fills the registry."""

from . import cohort, coverage, ingest, sequence, spectrum, stats, trios  # noqa: F401
from .core import ORACLES, QUERIES, as_callable


def queries():
    return {name: as_callable(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(ORACLES)
