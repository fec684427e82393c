"""Registered query plans (Spark side) and their DuckDB oracle SQL."""
