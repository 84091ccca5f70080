"""Operators for preparing training text: tokenising, deduplication, filters, scores, mixing.

Nothing else in the library imports this subpackage.  Every operator is a
function ``(DataFrame, ...) -> DataFrame``; ``registry.py`` holds the thin
registered queries and their DuckDB SQL.
"""
