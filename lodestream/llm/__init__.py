"""Training-data operators: ten Spark jobs over documents, pages and embeddings.

Nothing else in the library imports this subpackage; the registered queries and
their SQL are in :mod:`lodestream.llm.registry`.
"""
