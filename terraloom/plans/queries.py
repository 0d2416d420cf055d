"""All queries over surveyed space; importing the modules registers them."""

from __future__ import annotations

from . import analysis_queries, catalogue_queries, descriptor_queries, detail_queries, spatial_queries, world_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "voxel_moments"
