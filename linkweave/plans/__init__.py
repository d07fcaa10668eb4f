"""The catalogue of queries; importing this package enters all of them."""

from . import catalogue, ingest, significance, study
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "ingest", "significance", "study"]
