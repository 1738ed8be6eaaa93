"""Registered jobs and queries of the library."""

from corpusweave.jobs import queries_graph, queries_integrate, queries_retrieve  # noqa: F401
from corpusweave.jobs.registry import ORACLES, QUERIES  # noqa: F401
