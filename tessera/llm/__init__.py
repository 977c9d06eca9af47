"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every module holds one operator
with a general interface; :mod:`tessera.llm.queries` wraps them as the thin
``opN_<name>`` queries.
"""
