"""Operators that prepare text for language-model training.

Each operator takes and returns DataFrames.  The registered queries of this
subpackage are in ``queries`` and their SQL, where there is any, in ``oracles``.
"""
