"""Operators for preparing training text: deduplication, tokens, filtering, packing.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
with at least ``doc_id`` (integer) and ``text`` columns, selects those two and
ignores the rest, so further columns may have any name.
"""
