"""Codestrata: the source code of microservice systems as tables, for Spark."""
