"""Operators of a training-data pipeline: thirteen corpus-scale jobs over documents.

Nothing outside this subpackage imports it.  Every module holds one operator
with its own general interface; the thin ``opN_<name>`` queries live in
:mod:`palimpsest.llm.queries`.
"""
