"""Spark jobs that turn landed web pages into entity tables, profiles and reports."""
