"""Training-data operators: ten building blocks and the queries that apply them.

Nothing outside this subpackage imports it; ``queries.py`` is its only door.
"""
