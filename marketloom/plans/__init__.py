"""The registered queries of all modules."""

from marketloom.plans import files, geography, listings, queries, reports  # noqa: F401

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
