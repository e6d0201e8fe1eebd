"""Structured Streaming jobs: refresh cycles, pending sets and session grouping."""
