"""All queries of the library, its text operators apart."""

from __future__ import annotations

from . import q_composites, q_grid, q_learning, q_long, q_models, q_optimal, q_options, q_records, q_series, q_similarity, q_streaming, q_vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
