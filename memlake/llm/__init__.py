"""Training-data operators: one module per operator, queries.py registers them.

Nothing outside this subpackage imports it, so it can be removed on its own.
"""
