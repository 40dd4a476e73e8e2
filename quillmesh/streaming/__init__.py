"""Structured Streaming: ingestion of arriving sources."""
