"""Incremental ingestion: new files of a graph as a stream into its tables."""
