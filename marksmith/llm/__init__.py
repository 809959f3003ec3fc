"""Operators of a training-data pipeline over raw documents and web pages.

Nothing outside this subpackage imports it; ``marksmith.llm.catalog`` lists its queries.
"""
