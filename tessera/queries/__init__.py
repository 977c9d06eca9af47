"""Registered queries over the given tables, each with DuckDB SQL to check it."""
