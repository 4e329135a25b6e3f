"""Training-data operators.

Nothing else in the library imports this subpackage; its queries are collected in
``tidemark.llm.queries``.
"""
