"""Registered queries over the test tables, and the SQL they are checked against."""

from workload import listing, maintenance, questions, ranges, search, tables, texts  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
