"""Operators of a training-data pipeline: one module per operator.

Nothing else in the library imports this package.  Every operator takes and
returns DataFrames and keeps intermediate tables in the shared folder that
``spark.checkpoint.dir`` names (see :mod:`.common`).
"""
