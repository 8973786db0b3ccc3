"""Spark-native engine for memory records: retrieval, packing, analytics, graphs, ingest, streaming."""
