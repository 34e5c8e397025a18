"""Structured Streaming jobs: topic decode -> bronze append, dedupe, running marts, micro-batch ingest."""
