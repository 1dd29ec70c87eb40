"""Operators of a training-data pipeline over whole document tables.

Nothing outside this subpackage imports it; the queries and their SQL are in
``queries`` and are added by the entry module when the subpackage is there.
"""
