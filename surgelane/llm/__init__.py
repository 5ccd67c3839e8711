"""Operators for training-data pipelines: near duplicates, quality, packing,
extraction, sharding, search, language and mixing.

Each module takes DataFrames and returns DataFrames; nothing else in the
library imports this subpackage.
"""
