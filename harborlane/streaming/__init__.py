"""The same transforms driven by Structured Streaming."""
