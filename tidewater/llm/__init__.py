"""Training-data operators: deduplication, filters, classifiers, search,
mixing and packing over document tables.

Nothing outside this package imports it.  Operators take and return
DataFrames; ``queries`` registers one query per operator.
"""
