"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries.py`` has the
registered queries, ``oracles.py`` their SQL where SQL can express them.
"""
