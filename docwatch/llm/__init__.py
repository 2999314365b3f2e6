"""Corpus operators for training data: filters, joins, searches, mixing and sharding.

Every operator takes DataFrames and returns a DataFrame. Intermediate tables that are read
more than once are written below `spark.checkpoint.dir`, which all executors share.
"""
