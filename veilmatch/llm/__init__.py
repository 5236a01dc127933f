"""Operators for large-scale training-data pipelines; ``queries()`` and ``oracle_sql()`` register them."""
