"""Operators of a training-data pipeline: tokens, near copies, classifiers, cleaning.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` hold the driver queries of the ten operators.
"""
