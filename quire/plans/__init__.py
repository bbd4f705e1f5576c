"""Queries of the engine over the driver's tables."""

from quire.plans import assembly_queries, document_queries, geometry_queries, grid_queries, latex_queries, page_queries, paragraph_queries, rich_queries, sequence_queries, shape_queries, signal_queries, spatial_queries, structure_queries, text_queries  # noqa: F401
from quire.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
