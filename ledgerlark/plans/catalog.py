"""All registered queries and their oracles."""

from . import evaluation, ingest, reports, series, streams  # noqa: F401  (registration)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
