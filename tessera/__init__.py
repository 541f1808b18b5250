"""Tessera: a Spark-first engine for personal text archives."""
