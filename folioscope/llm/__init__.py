"""Operators of a training-data pipeline.

Each module holds one operator with a general interface; ``registry`` lists the queries
that apply them, with production parameters, to whole tables.  Nothing outside this
subpackage imports it.
"""
