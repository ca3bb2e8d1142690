"""The queries that the driver runs, and the SQL each is held against."""

from __future__ import annotations

from .plans.oracles import ORACLES
from .plans.queries import QUERIES, range_graph_from_index


def flagship(spark, sf_dir):
    """The K-NN graph of a key range, from the interval index."""
    return range_graph_from_index(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
