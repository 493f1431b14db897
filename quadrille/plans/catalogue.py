"""All query modules, so that importing this fills the registry."""

from quadrille.plans import convert_queries, grid_queries, matching_queries, network_queries, reader_queries, resolve_queries, scalar_queries, sequence_queries, source_queries, water_queries  # noqa: F401
from quadrille.plans.registry import QUERIES, SQL  # noqa: F401
