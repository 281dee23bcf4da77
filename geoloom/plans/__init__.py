"""Queries over the driver's tables, one or more for each operator, and their SQL."""

from geoloom.plans import q_agg, q_join, q_raster, q_rest, q_scalar  # noqa: F401
from geoloom.plans.registry import QUERIES, SQL


def queries():
    return QUERIES


def oracle_sql():
    return SQL
