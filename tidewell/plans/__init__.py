"""Queries on the driver tables; importing the modules registers them."""

from . import flow, intake, lookups, more, quality, records, scalars, search, workflow
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flow", "intake", "lookups", "more", "quality", "records", "scalars", "search", "workflow"]
