"""Scriptorium: search and maintenance of large multilingual document archives on Spark."""
