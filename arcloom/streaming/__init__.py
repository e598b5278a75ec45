"""The write path as Structured Streaming."""
