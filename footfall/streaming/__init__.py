"""Structured Streaming variants of the batch jobs."""
