"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` hold the registered queries; ``__spark_entry__.py`` adds
them if the subpackage is there.
"""
