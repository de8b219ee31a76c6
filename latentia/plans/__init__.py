"""Registered queries, each with SQL for an independent engine where it has a form for it."""
