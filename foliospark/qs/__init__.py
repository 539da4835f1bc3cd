"""Registered queries by area: each module runs operators over the given tables and states their DuckDB SQL."""
