"""Operators that prepare text for language-model training.

Nothing else in the library imports this subpackage.  Each operator takes and
returns DataFrames; :mod:`voxelspark.llm.queries` registers one query for each.
"""
