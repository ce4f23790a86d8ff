"""All registered queries of the bus-capture library and their SQL."""

from busfleet.plans import details, oracle, queries, streams

QUERIES = queries.QUERIES | details.QUERIES | streams.QUERIES
ORACLE = oracle.ORACLE | details.ORACLE | streams.ORACLE

__all__ = ["ORACLE", "QUERIES"]
