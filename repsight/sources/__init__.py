"""Schemas, readers, writers and the test-table mapping of the star schema."""

from repsight.sources.schema import SCHEMAS, Star

__all__ = ["SCHEMAS", "Star"]
