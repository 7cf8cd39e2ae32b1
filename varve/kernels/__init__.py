"""Dense numerical kernels on numpy arrays. They know nothing of Spark and run inside grouped functions.

A matrix has a row for each year and a column for each series; a missing value is NaN.
"""
