"""All registered queries."""

from scenetab.plans import files_queries, frames_queries, graph_queries, layers_queries, points_queries, rays_queries, splats_queries  # noqa: F401
from scenetab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
