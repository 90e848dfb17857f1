"""Structured Streaming: the same transforms on unbounded inputs."""
