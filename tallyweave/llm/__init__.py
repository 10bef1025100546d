"""Training-data operators: DataFrames in, DataFrames out.

Nothing else in the library imports this subpackage.
"""
