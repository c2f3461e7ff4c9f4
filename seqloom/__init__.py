"""Sequence motif analytics on PySpark."""
