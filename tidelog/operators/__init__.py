"""Table operators on logs, acks, pointers and payloads."""
