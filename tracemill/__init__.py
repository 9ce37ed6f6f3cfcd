"""Spark jobs over provenance-stamped ledgers, event logs and text corpora."""
