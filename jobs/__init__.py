"""Runnable jobs over the given tables: search_index (incremental) and archive (batch)."""
