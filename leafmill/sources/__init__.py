"""Readers of the tables the operators work on."""

from leafmill.sources.tables import table

__all__ = ["table"]
