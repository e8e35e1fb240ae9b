"""Operators for training-data pipelines.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds ``entries.QUERIES`` where it
can be imported.
"""
