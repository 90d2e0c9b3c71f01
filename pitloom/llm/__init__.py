"""Operators for training-data pipelines: each module is one operator, ``queries`` registers them.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
