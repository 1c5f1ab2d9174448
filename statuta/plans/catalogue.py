"""Every registered query of the text engine with its SQL twin."""

from . import boundary_queries, document_queries, feature_queries, model_queries, record_queries, structure_queries  # noqa: F401  they register themselves
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
