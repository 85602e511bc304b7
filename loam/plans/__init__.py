"""Registered queries by family: each module has QUERIES (name to function) and ORACLES (name to DuckDB SQL)."""
