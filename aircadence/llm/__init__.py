"""Operators for preparing large text corpora for model training.

Nothing else in the library imports this subpackage; its queries are added to
the registry by ``__spark_entry__.py`` only when it is present.
"""
