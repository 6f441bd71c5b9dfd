"""Operators of a training-data pipeline: deduplication, filtering, extraction,
tokenisation and packing of documents. Nothing else in the library imports this
subpackage; its queries are in :mod:`fleetscope.llm.queries`."""
