"""Named queries over the source tables; importing the modules registers them."""

from graphloom.plans import career_queries, composite_queries, example_queries, graph_queries, inference_queries, mention_queries, name_queries, ontology_queries, producer_queries, record_queries, source_queries, stored_queries, text_queries, unit_queries, view_queries  # noqa: F401
from graphloom.plans.registry import ORACLES, QUERIES  # noqa: F401
