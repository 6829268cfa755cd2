"""Operators of a training-data pipeline: text quality, duplicates, mixing, packing.

Each module holds one operator with its own interface; ``queries`` registers one query
per operator over the supplied tables. Nothing outside this folder imports it.
"""
