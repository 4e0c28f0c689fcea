"""Catalog, interaction and retrieval analytics as plain Spark jobs.

Every operator is a function ``DataFrame -> DataFrame``; nothing here runs on
the driver except small, bounded look-ups (a watermark, a count, a vocabulary
whose size is checked first).
"""
