"""Imports every query module, so that each registers its queries."""

from scriptorium.plans import archive_queries, corpus_queries, graph_queries, journal_queries, library_queries, note_queries, search_queries, source_queries, stream_queries, text_queries  # noqa: F401
from scriptorium.plans.registry import ORACLES, QUERIES  # noqa: F401
