"""Imports every query module and offers the filled registry."""

from . import queries_context, queries_panel, queries_scores  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
