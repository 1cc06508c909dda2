"""Operators for preparing large training corpora, and their queries."""
