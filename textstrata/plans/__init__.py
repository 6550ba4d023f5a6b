"""Queries over the standard tables, each with the DuckDB SQL it is held against."""
