"""Queries over the test tables, one for each operator, and their SQL."""

from argolith.queries.spark import QUERIES
from argolith.queries.sql import SQL

__all__ = ["QUERIES", "SQL"]
