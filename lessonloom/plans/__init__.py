"""Registered queries, the tables they read, and their reference SQL."""
