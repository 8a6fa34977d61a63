"""Operators for training-data pipelines (documents, pages, labels).

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and ``oracle_sql.py`` their DuckDB SQL.
"""
