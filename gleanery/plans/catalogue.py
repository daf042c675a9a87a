"""All queries of the core over the test tables, and their SQL."""

from gleanery.plans import curation, evaluation, files, learned, pictures, selection  # noqa: F401
from gleanery.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
