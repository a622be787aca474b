"""Training-data operators: filtering, de-duplication, tokenisation, packing and media columns.

Nothing outside this subpackage imports it. Each module holds one operator with a
general interface; :mod:`threadloom.llm.queries` holds the thin registered queries.
"""
