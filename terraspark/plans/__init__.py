"""Whole plans: inference, comparison, and the registered queries with their oracles."""
