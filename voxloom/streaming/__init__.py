"""Structured Streaming forms of the job-queue operators."""
