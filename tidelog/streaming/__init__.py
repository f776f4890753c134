"""Structured Streaming jobs on logs and acks."""
