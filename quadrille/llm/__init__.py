"""Operations of a large-scale training-data pipeline, on Spark DataFrames.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own interface; ``queries`` holds the thin registered queries over the tables.
"""
