"""Streams.

The package has no stateful stream operator. Row-wise operators (everything in
`operators.clean` that takes one table, and `functions.calendar`) also run on a
streaming DataFrame; `tests/test_sources.py` shows it. Operators that need the
rows of a series in order do not.
"""
