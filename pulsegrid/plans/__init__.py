"""Whole plans: the registered queries, their SQL, and experiments."""
