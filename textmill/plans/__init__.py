"""Whole workflows, and the registered queries with their SQL."""
