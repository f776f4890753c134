"""Join strategy and named SQL."""
