"""Queries over the tables, as registered in __spark_entry__.py."""
