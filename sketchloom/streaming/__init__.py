"""Structured Streaming: observations into records as they come."""
