"""Sequenced logs, ack frontiers and typed payloads as Spark jobs."""
