"""Operators for preparing language-model training data on Spark.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; :mod:`codeloom.llm.registry` holds the thin queries.
"""
