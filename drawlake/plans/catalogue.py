"""Collects the registered queries of every family."""

from drawlake.plans import inputs  # noqa: F401
from drawlake.plans import certify, contours, contracts, corpus, evidence, geometry, ledgers, masks, report, scale, text  # noqa: F401
from drawlake.plans import registry


def queries():
    return registry.spark_queries()


def oracles():
    return registry.oracle_queries()
