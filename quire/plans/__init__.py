"""Composed plans: the whole document run, derived input tables, and the registered queries."""
