"""Column expressions: pure functions from columns to a column."""
