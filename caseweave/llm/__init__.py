"""Operators of a training-data pipeline; ``queries.QUERIES`` and ``queries.ORACLE`` register them."""
