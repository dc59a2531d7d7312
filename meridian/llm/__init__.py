"""Operators for preparing large text corpora.

Nothing outside this folder imports it.  ``catalog.queries()`` and
``catalog.oracle_sql()`` list what the entry point registers.
"""
