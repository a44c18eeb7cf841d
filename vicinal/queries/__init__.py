"""All queries of the library."""

from vicinal.queries import entities, features, graphs, scores
from vicinal.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "entities", "features", "graphs", "scores"]
