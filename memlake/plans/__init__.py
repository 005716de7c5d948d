"""The query catalogue: importing it registers every query."""

from . import belief_queries, corpus_queries, model_queries, rank_queries, store_queries
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "belief_queries", "corpus_queries", "model_queries", "rank_queries", "store_queries"]
