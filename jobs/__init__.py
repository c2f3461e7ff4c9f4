"""Runnable jobs: each reads given tables, writes partitioned output and can be run again."""
