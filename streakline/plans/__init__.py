"""Composite jobs, views over the sample tables and the query registry."""
