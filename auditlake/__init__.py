"""Findings analytics for code and text corpora, expressed as Spark jobs."""
