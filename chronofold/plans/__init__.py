"""Registered queries with their DuckDB SQL."""
