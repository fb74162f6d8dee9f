"""All queries over the driver tables, with their SQL."""

from . import evaluation, fields, records  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
