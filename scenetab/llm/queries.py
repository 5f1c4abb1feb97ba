"""All queries of this folder."""

from scenetab.llm import corpus_queries, model_queries, native_queries

QUERIES = {**native_queries.QUERIES, **model_queries.QUERIES, **corpus_queries.QUERIES}
ORACLES = {**native_queries.ORACLES, **model_queries.ORACLES, **corpus_queries.ORACLES}
