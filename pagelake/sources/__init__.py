"""Readers and writers for landed pages, sitemaps, API responses, entity tables and reports."""
