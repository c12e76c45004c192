"""Streaming variants: the same operators over Structured Streaming sources."""
