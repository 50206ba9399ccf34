"""Operators for preparing language-model training data.

Every operator is a function from DataFrames to DataFrames; ``queries`` binds
them to the driver's tables.  Nothing else in the library imports this
subpackage.
"""
