"""The job queue as Structured Streaming."""
