"""The queries that the driver runs, and DuckDB SQL for them."""

from .plans import layout as layout
from .plans import repairs as repairs
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
