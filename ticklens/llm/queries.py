"""Imports every query module, so that the registry is full."""

from ticklens.llm import native_queries, text_queries  # noqa: F401
from ticklens.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
