"""Spark-first analytics over contact networks: listing, search, matching, ingest."""
